"""Language identification by compression.

Fit: a raw-content zstandard dictionary per language, cut from a bounded
sample of its labelled texts. Predict: every whole text is brought to
lower-case words (letters only, so punctuation and figures say nothing),
compressed piece by piece with each dictionary, and the language whose
dictionary gives the fewest bytes wins. When the runner-up is nearly as small the margin
is narrow and the document is not ``accepted``.

Defined results: null or empty text, or one without a letter, is ``und`` with
score 0 and is not accepted. Equal sizes go to the alphabetically first
language with margin 0. A null label or a null id is never learned from. With
nothing to learn from every document is ``und``. Repeated rows and extra
columns have no influence on a prediction.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

UND = "und"
#: Labelled documents per language that a dictionary is cut from (the fit's bound).
SAMPLE_DOCS = 512
#: Bytes taken from the middle of each sampled document.
CUT_BYTES = 768
#: Bytes compressed at once; long texts are summed over pieces, so that the
#: dictionary and not the text's own beginning decides.
PIECE_BYTES = 2048
LEVEL = 3
#: A text shorter than this is repeated up to it: the copies cost next to
#: nothing, and the block is then surely compressed, not stored.
SHORT_BYTES = 96
#: What is not a letter.
GAP = re.compile(r"[\W\d_]+")
#: Share by which the best size must beat the runner-up for acceptance.
MIN_MARGIN = 0.004
#: Margin at which the score reaches 1 - 1/e.
MARGIN_SCALE = 0.02

PREDICTION = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()),
                        ("margin", pa.float64()), ("accepted", pa.bool_())])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """One dictionary per language from at most ``sample_docs`` labelled
    documents each, picked by a hash of the id (all rows are counted; the
    counts set the picking rate, so about ``sample_docs`` rows per language
    are fetched whatever the input's size)."""
    d = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")) \
        .where("i is not null and l is not null and t is not null")
    counts = {r["l"]: r["n"] for r in d.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    want = sample_docs + 6 * math.sqrt(sample_docs)
    rate = F.create_map(*[F.lit(x) for l, n in sorted(counts.items()) for x in (l, min(1.0, want / n))])
    d = d.withColumn("u", C.unit_hash(F.col("i"), salt="langid")).where(F.col("u") < rate[F.col("l")])
    middle = F.greatest(F.lit(1), (F.length("t") / 2 - F.lit(CUT_BYTES // 2)).cast("int"))
    rows = d.select("l", "u", "i", F.substring(F.col("t"), middle, F.lit(CUT_BYTES)).alias("t")).collect()
    cuts = {lang: [plain(r["t"])[:CUT_BYTES] for r in sorted((r for r in rows if r["l"] == lang), key=lambda r: (r["u"], r["i"], r["t"]))][:sample_docs]
            for lang in sorted(counts)}
    return {lang: b"\n".join(c) for lang, c in cuts.items()}


def plain(text: str) -> bytes:
    """Lower-case words, one blank between."""
    return GAP.sub(" ", text.lower()).strip().encode("utf-8", "replace")


class Classifier:
    """Compressors of one fitted model; built once per task."""

    def __init__(self, model: dict[str, bytes], min_margin: float = MIN_MARGIN):
        self.langs = sorted(model)
        self.min_margin = min_margin
        self.codecs = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.codecs.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False,
                                                        write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = plain(text)
        if len(data) < SHORT_BYTES:
            data = (data + b" ") * (SHORT_BYTES // (len(data) + 1) + 1)
        pieces = [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.codecs]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UND, 0.0, 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0, True
        second = min(s for k, s in enumerate(sizes) if k != best)
        margin = (second - sizes[best]) / second
        return self.langs[best], 1.0 - math.exp(-margin / MARGIN_SCALE), margin, margin >= self.min_margin


def _predict_batches(model: dict[str, bytes], min_margin: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    clf = Classifier(model, min_margin)
    for b in C.sliced(batches):
        got = list(zip(*[clf.predict(t) for t in C.texts(b, "text")]))
        keep = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "text"]
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(keep + [pa.array(g, f.type) for g, f in zip(got, PREDICTION)], names + PREDICTION.names)


def predict(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
            min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), margin, accepted per input row: one
    pass over the scan, no shuffle."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(functools.partial(_predict_batches, model, min_margin),
                        "doc_id long, lang_pred string, score double, margin double, accepted boolean")


def _keep_batches(model: dict[str, bytes], min_margin: float, text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    clf = Classifier(model, min_margin)
    for b in C.sliced(batches):
        yield b.filter(pa.array([clf.predict(t)[3] for t in C.texts(b, text_col)], pa.bool_()))


def keep_identified(docs: DataFrame, model: dict[str, bytes], text_col: str = "text",
                    min_margin: float = MIN_MARGIN) -> DataFrame:
    """The input's rows and columns without the documents that are rejected."""
    return docs.mapInArrow(functools.partial(_keep_batches, model, min_margin, text_col), docs.schema)


def learn_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that labels may be learned from: the fold of the id is not 2 of 4."""
    return docs.where(C.fold(id_col, 4) != 2)


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(learn_rows(docs))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(C.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "margin", "accepted")
