"""Registered queries: one per operator of the inventory, each with its
DuckDB oracle statement when SQL can express it.

Every query reads the driver's tables (or rows Spark derives from them), so
its work grows with the input. Computed doubles are rounded to 9 decimals in
both engines so last-bit differences between two correct engines do not
count as mismatches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures as FX
from . import scoring as S

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r9(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 9) + F.lit(0.0))


def doc_scored(spark, sf_dir, **kw) -> DataFrame:
    return S.score(FX.rollouts(spark, sf_dir), **kw)


def event_scored(spark, sf_dir, **kw) -> DataFrame:
    """Scored events rollouts, for plans that read them once."""
    return S.score(FX.rollouts_events(spark, sf_dir), **kw)


def event_table(spark, sf_dir, columns: tuple = S.GROUP_COLUMNS, **kw) -> DataFrame:
    """The named columns of scored events rollouts, written once, for
    branching group plans."""
    return S.scored_table(event_scored(spark, sf_dir, **kw), columns)


# importing the query modules fills QUERIES / ORACLE
from . import q_batching, q_core, q_extra, q_groups, q_normalize, q_prompts, q_runlog, q_streaming, q_tokens  # noqa: E402,F401,I001
