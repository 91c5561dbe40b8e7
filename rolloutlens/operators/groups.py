"""Group operators: one group = the completions of one prompt.

Decomposable statistics (mean, population std, min, max, counts) are plain
``groupBy().agg()`` - partial aggregation before the shuffle, so a hot
prompt costs one row per map task - joined back on the key, where AQE's
skew join splits a hot key's partition. Order-dependent work (W2, G2) goes
through :mod:`rolloutlens.operators.ordered`, which chunks every key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import answers as A
from . import ordered

KEY = "prompt_idx"
POS = "gen_idx"


def group_stats(df: DataFrame, key: str = KEY, reward: str = "reward",
                acc: str | None = "acc", length: str | None = None) -> DataFrame:
    """Per-group mean/population-std of rewards, accuracy mean,
    mean length, size, and whether the gold label was unparseable (F3)."""
    aggs = [F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"),
            F.count(F.lit(1)).alias("n")]
    if acc:
        aggs.append(F.avg(acc).alias("acc_mean"))
    if length:
        aggs.append(F.avg(length).alias("mean_length"))
    if "gold_ans" in df.columns:
        aggs.append(F.max(F.col("gold_ans.canon").isNull()).alias("gold_unparsed"))
    return df.groupBy(key).agg(*aggs)


def with_advantages(df: DataFrame, stats: DataFrame | None = None, key: str = KEY,
                    reward: str = "reward", eps: float = C.ADVANTAGE_EPS) -> DataFrame:
    """advantage = (r - mean) / (std_pop + eps), group stats (partially
    aggregated) joined back onto the clustered rows (only the per-group side
    moves)."""
    if stats is None:
        stats = group_stats(df, key, reward, acc=None)
    s = stats.select(key, "mean", "std")
    return (ordered.attach(df, s, key, POS)
              .withColumn("advantage", (F.col(reward) - F.col("mean")) / (F.col("std") + F.lit(eps))))


def drop_flat_groups(df: DataFrame, threshold: float = C.FLAT_GROUP_STD) -> DataFrame:
    """keep rows of groups whose population std >= threshold."""
    return df.filter(F.col("std") >= F.lit(threshold))


def keep_positive(df: DataFrame) -> DataFrame:
    """keep rows with advantage > 0 (strict)."""
    return df.filter(F.col("advantage") > F.lit(0.0))


def with_connect(df: DataFrame, key: str = KEY, pos: str = POS, ans: str = "ans") -> DataFrame:
    """``connect`` = answer equivalent to the previous generation's."""
    d = ordered.with_previous(df, key, pos, [ans])
    return d.withColumn("connect", A.answers_equal(F.col(ans), F.col("prev_" + ans)))


def majority_run(df: DataFrame, key: str = KEY, pos: str = POS, ans: str = "ans",
                 value: str = "acc", chunk: int = ordered.CHUNK) -> DataFrame:
    """Per group, ``value`` of the first member of the longest run of
    consecutive equivalent (parseable) answers; ties -> earliest run; no
    parseable answer -> 0.0; unparseable gold -> 1.0.

    Gaps and islands without a whole-group window: run starts come from the
    chunked previous-row lookup, each row's run start is a chunked running
    max, run sizes a partial aggregate, the winner a ``max_by`` on one packed
    bigint (longer run first, then earlier start).
    """
    gold_flag = (F.col("gold_ans.canon").isNull() if "gold_ans" in df.columns else F.lit(False))
    base = df.select(key, pos, ans, value, gold_flag.alias("_gold_unparsed"))
    d = ordered.with_previous(base, key, pos, [ans], chunk=chunk)
    parsed = F.col(ans + ".canon").isNotNull()
    start = parsed & ~A.answers_equal(F.col(ans), F.col("prev_" + ans))
    d = d.withColumn("_start_pos", F.when(start, F.col(pos)))
    d = ordered.running_max(d, key, pos, "_start_pos", "_run0", chunk=chunk)
    d = d.withColumn("_run", F.when(parsed, F.col("_run0")))
    runs = d.groupBy(key, "_run").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.col(value), F.col(pos)).alias("_v0"),
        F.max("_gold_unparsed").alias("_gu"))
    # rank: longer run first, then earlier start (positions < 2**32)
    rank = F.when(F.col("_run").isNotNull(),
                  F.col("_n").cast("long") * F.lit(1 << 32) + (F.lit((1 << 32) - 1) - F.col("_run").cast("long")))
    best = runs.groupBy(key).agg(F.max_by(F.col("_v0"), rank).alias("_best"), F.max(rank).alias("_rk"),
                                 F.max("_gu").alias("_gu"))
    return best.select(key, F.when(F.col("_gu"), F.lit(1.0))
                       .when(F.col("_rk").isNull(), F.lit(0.0))
                       .otherwise(F.col("_best").cast("double")).alias("majority"))


def majority_mode(df: DataFrame, key: str = KEY, pos: str = POS, ans: str = "ans",
                  value: str = "acc") -> DataFrame:
    """Extra (clearly not the reference's rule): ``value`` of the first member
    of the most common canonical answer; ties -> the answer seen first."""
    counts = (df.filter(F.col(ans + ".canon").isNotNull())
                .groupBy(key, F.col(ans + ".canon").alias("_canon"))
                .agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"),
                     F.min_by(F.col(value), F.col(pos)).alias("_v")))
    return counts.groupBy(key).agg(
        F.max_by("_v", F.struct(F.col("_n"), -F.col("_first"))).cast("double").alias("majority_mode"))


def run_metrics(rows: DataFrame, groups: DataFrame, votes: DataFrame | None = None,
                key: str = KEY) -> DataFrame:
    """Mean group accuracy, mean majority, mean of all rewards, mean of
    group mean length - all before F1/F2. Empty input -> NULLs. ``groups``
    may already carry ``majority`` (see scoring.group_report)."""
    if votes is not None:
        groups = groups.join(votes, key, "left")
    g = groups.agg(
        F.avg("acc_mean").alias("acc_ave"), F.avg("majority").alias("acc_major"),
        F.avg("mean_length").alias("length"), F.count(F.lit(1)).alias("n_groups"))
    r = rows.agg(F.avg("reward").alias("reward"), F.count(F.lit(1)).alias("n_rows"))
    return _one_row_join(g, r)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two single-row aggregates on a constant key (no cross join)."""
    return (a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one")
             .drop("_one"))
