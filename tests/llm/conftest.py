import pytest
from pyspark.sql import types as T

#: Columns whose names the operators use inside.
EXTRA = ["doc", "row", "pos", "h", "fp", "u", "i", "y", "l", "t", "x", "score", "item", "bin", "length", "sequence_id", "bucket", "first", "term", "id"]
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                          *[T.StructField(c, T.StringType()) for c in EXTRA]])


def document_rows(texts, start=0, lang=None):
    """Rows of documents; texts: texts or (id, text)."""
    out = []
    for k, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (start + k, t)
        out.append((i, t, lang, "src", None if t is None else len(t), *["clash"] * len(EXTRA)))
    return out


@pytest.fixture
def documents(spark):
    def make(texts, start=0, parts=3, lang=None):
        return spark.createDataFrame(document_rows(texts, start, lang), DOCUMENTS).repartition(parts)
    return make


#: Nulls, empty and very long texts, repeated rows and ids, ties.
LONG = "A very long line that never seems to end " * 4000
EDGES = [(1, None), (2, ""), (3, "one"), (4, "Same line here\nshort\n  SAME line here "), (5, "Same line here\nother words follow here"),
         (6, LONG), (6, LONG), (6, "another text of the same id\nSame line here"), (None, "Same line here"), (None, None),
         (8, "\n\n"), (9, "☃ ünïcode 日本語 text \t tab"), (10, "one"), (-7, "Negative ids come first of all")]


@pytest.fixture
def edges(documents):
    return documents(EDGES)
