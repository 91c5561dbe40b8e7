"""Corpus pipeline: toxicity, language ID, line dedup, SimHash near-dedup,
best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each stage's result as Parquet in the session's shared checkpoint
folder and rereads it as the next stage's documents. All but the last return
the columns of the input documents.

Each stage works on all that its predecessor kept. A null text passes the
toxicity stage (it holds nothing toxic), is rejected by language ID (no
language), and later stages treat it as empty. Equal ids are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlens.llm import common as C
from rolloutlens.llm import langid, linededup, packing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold. The model is fitted on the
    labels of the documents that are here, in the folds it may learn from."""
    model = toxicity.fit(docs, toxicity.learn_rows(C.table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart by a clear margin."""
    return langid.keep_identified(docs, langid.fit(langid.learn_rows(docs)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows the text."""
    chars = "n_chars" if "n_chars" in docs.columns else None
    return linededup.drop_lines(docs, chars_col=chars)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group."""
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_group),
    ("best_fit_packing", pack),
]

#: Stages 1, 2, 4 and 5 are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
