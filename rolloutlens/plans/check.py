"""Spark-vs-DuckDB comparison used by the tests and ``tools/check.py``.

Both results are brought to pandas, columns sorted by name, floats rounded,
rows sorted; equal frames mean the registered query matches its oracle.
"""

from __future__ import annotations

import math
import os

import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duckdb_conn(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return _norm(float(v))
    except Exception:
        pass
    return v


def normalise(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0)
                                          if not isinstance(x, tuple) else (False, "t", str(x)) for x in r))


SPARK_TYPES = {"int": "int32", "bigint": "int64", "double": "float64", "string": "string",
               "boolean": "bool", "float": "float32", "smallint": "int16", "tinyint": "int8"}
DUCK_TYPES = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "VARCHAR": "string",
              "BOOLEAN": "bool", "FLOAT": "float32", "SMALLINT": "int16", "TINYINT": "int8"}


def type_mismatches(spark_df, con, sql: str) -> dict:
    sp = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in spark_df.schema.fields}
    rel = con.sql(sql)
    du = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    return {k: (sp.get(k), du.get(k)) for k in set(sp) | set(du) if sp.get(k) != du.get(k)}


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    bad_types = type_mismatches(spark_df, con, sql)
    if bad_types:
        return False, f"column types differ (spark, oracle): {bad_types}"
    s = spark_df.toPandas()
    d = con.execute(sql).fetchdf()
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns differ: spark={sorted(s.columns)} oracle={sorted(d.columns)}"
    if len(s) != len(d):
        return False, f"row count differs: spark={len(s)} oracle={len(d)}"
    a, b = normalise(s), normalise(d)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} oracle={bad[0][1]}"
    return True, f"{len(s)} rows equal"
