"""Line dedup over a corpus.

A line's key is the line stripped of ASCII white space and lower-cased (A-Z).
Of a key of at least ``min_chars`` code points that several documents hold,
only the lines of the smallest document id stay.

Method: lines become (key hash, document, position) records; text is not
shuffled for the search. The records are range-partitioned and sorted by
hash, document and position, so a line that a third of all documents share is
spread over as many partitions as it fills. Each partition streams its
records and notes the first document of every hash; a hash that began in an
earlier partition takes its first document from that partition's summary (one
row per partition). The result is one zlib-compressed keep bitmap for every
document that loses a line; other documents keep all lines.

Defined results: null and empty text are one empty line. All rows of one id
are one document, so a key held only by them stays; each row gets its own
bitmap. Null ids are together one document after all others. An empty table
gives no bitmaps.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_CHARS = 10
#: The white space of the contract: tab to carriage return, and the blank.
BLANKS = "".join(map(chr, [32, *range(9, 14)]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (null ids last), row (hash of the text, tells rows of one id apart), text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.LAST_ID)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def line_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """h (16 bytes), doc, row, pos of every line whose key is long enough."""
    lines = _row_key(docs, id_col, text_col).select("doc", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = lines.withColumn("key", line_key(F.col("line")))
    return key.where(F.length("key") >= min_chars).select(F.unhex(F.md5("key")).alias("h"), "doc", "row", "pos")


def _stream_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted records in; out: the same with the first document of the hash as
    this partition knows it. Only the last hash is held between batches."""
    last, first = None, None
    for b in batches:
        h, doc = b.column("h").to_pylist(), b.column("doc").to_pylist()
        out = []
        for x, d in zip(h, doc):
            if x != last:
                last, first = x, d
            out.append(first)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "first"])


def dropped_records(records: DataFrame) -> DataFrame:
    """doc, row, pos of the lines that go."""
    spark = records.sparkSession
    n = C.shuffle_partitions(spark)
    run = (records.repartitionByRange(n, "h", "doc", "pos").sortWithinPartitions("h", "doc", "pos")
           .mapInArrow(_stream_first, "h binary, doc long, row long, pos int, first long")
           .withColumn("part", F.spark_partition_id()))
    run = C.written(run, "linededup-runs")
    # one row per partition: its first and last hash and the document either began with
    ends = run.groupBy("part").agg(F.min(F.struct("h", "first")).alias("a"), F.max(F.struct("h", "first")).alias("z")) \
        .orderBy("a.h", "a.first", "z.h", "z.first").collect()
    carried, before = [], None  # before: (hash, its first document) as the partitions so far end
    for e in ends:
        a, z = e["a"], e["z"]
        known = before is not None and bytes(before[0]) == bytes(a["h"])
        if known:
            carried.append((e["part"], bytes(a["h"]), before[1]))
        before = before if known and bytes(z["h"]) == bytes(a["h"]) else (z["h"], z["first"])
    carry = spark.createDataFrame(carried, "part int, h binary, carried long")  # a row per partition at most
    first = F.coalesce("carried", "first")
    return run.join(F.broadcast(carry), ["part", "h"], "left").where(F.col("doc") > first).select("doc", "row", "pos")


def _bitmap(pos: list[int]) -> bytes:
    """Compressed keep bits, one per line up to the last that goes; lines beyond stay."""
    keep = np.ones(-(-(max(pos) + 1) // 8) * 8, np.uint8)  # whole bytes, the padding keeps
    keep[pos] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(text: str, bitmap: bytes | None) -> tuple[list[str], int]:
    """The lines that stay and the number of lines before."""
    lines = text.split("\n")
    if bitmap is None:
        return lines, len(lines)
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]], len(lines)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.sliced(batches, 4096):
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("row"), pa.array([_bitmap(p) for p in b.column("gone").to_pylist()], pa.binary()),
                                          pa.array([len(p) for p in b.column("gone").to_pylist()], pa.int64())], ["doc", "row", "bitmap", "n_dropped"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, row, bitmap, n_dropped of every document row that loses a line.
    A list of positions is no longer than its document has lines."""
    gone = dropped_records(line_records(docs, id_col, text_col, min_chars))
    return gone.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone")) \
        .mapInArrow(_bitmaps, "doc long, row long, bitmap binary, n_dropped long")


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The input with its row's bitmap (null: all lines stay) as last column
    ``_bitmap``; ids are spread, so the join has no hot key."""
    maps = C.written(keep_bitmaps(docs, id_col, text_col, min_chars), "linededup-bitmaps") \
        .select(F.col("doc").alias("_ld_doc"), F.col("row").alias("_ld_row"), F.col("bitmap").alias("_bitmap"))
    keyed = docs.withColumn("_ld_id", F.coalesce(F.col(id_col).cast("long"), F.lit(C.LAST_ID))) \
        .withColumn("_ld_text", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    # the narrow side is hashed, so the texts are not sorted
    joined = keyed.join(maps.hint("shuffle_hash"), (F.col("_ld_id") == F.col("_ld_doc")) & (F.col("_ld_text") == F.col("_ld_row")), "left")
    return joined.drop("_ld_id", "_ld_text", "_ld_doc", "_ld_row")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.sliced(batches):
        out = []
        for t, m in zip(C.texts(b, "text"), b.column("_bitmap").to_pylist()):
            kept, n = kept_lines(t, m)
            out.append((n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        n, gone, sha = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                                         ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _apply(text_col: str, chars_col: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.sliced(batches):
        texts, maps = b.column(text_col).to_pylist(), b.column("_bitmap").to_pylist()
        kept = [t if m is None else "\n".join(kept_lines(t, m)[0]) for t, m in zip(texts, maps)]
        cols = {n: b.column(n) for n in b.schema.names if n != "_bitmap"}
        cols[text_col] = pa.array(kept, b.schema.field(text_col).type)
        if chars_col:
            old = b.column(chars_col).to_pylist()
            cols[chars_col] = pa.array([o if m is None else len(t) for o, t, m in zip(old, kept, maps)], b.schema.field(chars_col).type)
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None,
               min_chars: int = MIN_CHARS) -> DataFrame:
    """The input's rows and columns with the lines that go cut from the text
    (and ``chars_col`` set to the new length where a line went)."""
    return with_bitmaps(docs, id_col, text_col, min_chars).mapInArrow(functools.partial(_apply, text_col, chars_col), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_bitmaps(docs).mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key
)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE f.first_doc IS NOT NULL AND f.first_doc < k.doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.first_doc IS NULL OR f.first_doc = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id
"""
