"""Language ID: held-out accuracy, and each defined edge case."""
import pytest

from rolloutlens.llm import common as C
from rolloutlens.llm import langid as L

from .conftest import EDGES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(L.learn_rows(C.table(spark, SF, "documents")))


def test_held_out_accuracy(spark):
    got = L.query(spark, SF).join(C.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_rows_match_one_by_one_prediction(documents, model):
    clf = L.Classifier(model)
    got = L.predict(documents(EDGES), model).collect()
    want = [(i, *clf.predict(t)) for i, t in EDGES]
    key = lambda r: (str(r[0]), r[1], r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_defined_edges(model):
    clf = L.Classifier(model)
    for t in (None, "", "123 ... 45!", "\n \t", "🙂"):
        assert clf.predict(t) == (L.UND, 0.0, 0.0, False)
    assert L.Classifier({}).predict("a word") == (L.UND, 0.0, 0.0, False)
    assert clf.predict("the " * 50_000)[0] == clf.predict("the " * 50_000)[0] != L.UND


def test_narrow_margin_is_rejected():
    same = b"words that both languages share " * 20
    lang, score, margin, accepted = L.Classifier({"a": same, "b": same}).predict("words that both languages share")
    assert (lang, margin, accepted) == ("a", 0.0, False) and score == 0.0


def test_labels_that_are_null_or_held_out_are_not_learned(documents, spark):
    assert L.fit(documents(EDGES)) == {} and L.fit(documents([], lang="xx")) == {}
    rows = documents([(k, f"text number {k}") for k in range(40)], lang="xx")
    held = {r["doc_id"] for r in rows.collect()} - {r["doc_id"] for r in L.learn_rows(rows).collect()}
    import zlib
    assert held == {k for k in range(40) if zlib.crc32(str(k).encode()) % 4 == 2}


def test_stage_keeps_schema_and_accepted_rows(edges, model):
    got = L.keep_identified(edges, model)
    clf = L.Classifier(model)
    assert got.schema == edges.schema
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(i) for i, t in EDGES if clf.predict(t)[3])


def plain_sizes(model, text):
    """Compressed sizes of the text's pieces per language, each by a compressor of its own."""
    import re

    import zstandard
    data = re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode("utf-8", "replace")
    while len(data) < L.SHORT_BYTES:
        data = (data + b" ") * (L.SHORT_BYTES // (len(data) + 1) + 1)
    out = {}
    for lang, words in model.items():
        total = 0
        for i in range(0, len(data), L.PIECE_BYTES):
            raw = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=L.LEVEL)
            c = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)
            total += len(c.compress(data[i:i + L.PIECE_BYTES]))
        out[lang] = total
    return out


def test_whole_table_equals_sizes_computed_one_by_one(spark):
    """Prediction, margin and rejection of every document by brute force: the
    fewest bytes win (ties: the first language), margins under the limit are rejected."""
    sf = "/root/testdata/sf0.001"
    docs = C.table(spark, sf, "documents")
    model = L.fit(L.learn_rows(docs))
    got = {r["doc_id"]: r for r in L.predict(docs, model).collect()}
    query = {r["doc_id"]: r for r in L.query(spark, sf).collect()}
    rejected = 0
    for r in docs.collect():
        if not any(map(str.isalpha, r["text"] or "")):
            assert got[r["doc_id"]]["lang_pred"] == L.UND
            continue
        sizes = sorted((n, lang) for lang, n in plain_sizes(model, r["text"]).items())
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        g = got[r["doc_id"]]
        assert (g["lang_pred"], g["accepted"]) == (sizes[0][1], margin >= L.MIN_MARGIN) and g["margin"] == pytest.approx(margin)
        assert query[r["doc_id"]]["lang_pred"] == sizes[0][1]
        rejected += not g["accepted"]
    assert len(got) == len(query) == docs.count() and rejected <= 0.05 * len(got)
