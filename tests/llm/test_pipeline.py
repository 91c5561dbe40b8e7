"""The pipeline stage by stage against plain loops over all documents, and the registered queries."""
import pytest

import __spark_entry__
import corpus_pipeline
from rolloutlens.llm import common as C
from rolloutlens.llm import langid, packing, toxicity
from rolloutlens.llm.queries import ORACLE, QUERIES
from rolloutlens.plans.check import compare, duckdb_conn

from .test_line_dedup import plain as plain_lines
from .test_packing import check_places
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(QUERIES) <= names and set(ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    ok, why = compare(QUERIES[name](spark, SF), duckdb_conn(SF), ORACLE[name])
    assert ok, why


def test_stages_equal_plain_loops(spark):
    docs = C.table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    # toxicity
    scorer = toxicity.Scorer(toxicity.fit(docs, toxicity.learn_rows(C.table(spark, SF, "labels"))))
    kept = C.written(corpus_pipeline.drop_toxic(spark, docs, SF), "test-stage")
    assert kept.schema == docs.schema
    want = {i for i, r in rows.items() if scorer.score([r["text"]])[0] < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in kept.collect()} == want
    # language
    clf = langid.Classifier(langid.fit(langid.learn_rows(kept)))
    known = C.written(corpus_pipeline.keep_identified(spark, kept, SF), "test-stage")
    want = {i for i in want if clf.predict(rows[i]["text"])[3]}
    assert known.schema == docs.schema and {r["doc_id"] for r in known.collect()} == want
    # lines
    cut = C.written(corpus_pipeline.drop_repeated_lines(spark, known, SF), "test-stage")
    import hashlib
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()) == sorted(
        (x[0], x[3]) for x in plain_lines([(i, rows[i]["text"]) for i in want]))
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect()) and cut.schema == docs.schema
    # near duplicates
    one = C.written(corpus_pipeline.keep_one_of_group(spark, cut, SF), "test-stage")
    groups = plain_components([(i, plain_fingerprint(t)) for i, t in texts.items()], 2)
    left = {i for i, c in groups.items() if i == c}
    assert one.schema == docs.schema and {r["doc_id"] for r in one.collect()} == left
    # packing
    got = C.written(corpus_pipeline.pack(spark, one, SF), "test-stage").collect()
    check_places(got, packing.CAPACITY)
    assert {r["doc_id"] for r in got} == left


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_stages_take_edge_rows_and_empty_tables(spark, edges, documents):
    for docs in (edges, documents([])):
        for name, stage in corpus_pipeline.STAGES:
            docs = C.written(stage(spark, docs, SF), "test-edge")
        assert docs.columns[0] == "doc_id"
