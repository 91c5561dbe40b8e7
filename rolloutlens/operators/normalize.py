"""Normalisers along a dimension of long-form data.

Long form = one row per element ``(row key, position, value[, mask])``.
"dim=1" (per sequence) groups by the row key; "dim=0" (per position) groups
by the position. Statistics are grouped aggregates (partial aggregation);
they come back to the rows through :func:`ordered.attach_measured`, so a hot
key's rows stay spread as they were read. Cumulative sums use the chunked scan
from :mod:`rolloutlens.operators.ordered`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from . import ordered


def cumulative_sum(df: DataFrame, key: str, pos: str, value: str, out: str = "cumsum",
                   reverse: bool = False, chunk: int = ordered.CHUNK, dense: bool = True) -> DataFrame:
    """Running sum of ``value`` along ``pos`` inside ``key``; reverse =
    suffix sum (total - prefix + value). ``dense=False`` for positions that are
    ids or hashes: chunks are then ranges of positions."""
    by = None if dense else ordered.range_chunk(df, pos, chunk)
    d = ordered.running_sum(df, key, pos, value, "_fwd", chunk=chunk, by=by)
    if not reverse:
        return d.withColumnRenamed("_fwd", out)
    return (ordered.attach_measured(d, key, [F.sum(value).alias("_tot")], of=df)
                   .withColumn(out, F.col("_tot") - F.col("_fwd") + F.col(value)).drop("_fwd", "_tot"))


def zscore(df: DataFrame, key: str, value: str, out: str = "z", eps: float = C.ZSCORE_EPS) -> DataFrame:
    """(x - mean) / (sample std + eps) per key; a one-element group has
    no sample std, so its z is NULL."""
    st = [F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std")]
    return (ordered.attach_measured(df, key, st).withColumn(out, (F.col(value) - F.col("_mean")) / (F.col("_std") + F.lit(eps)))
              .drop("_mean", "_std"))


def masked_zscore(df: DataFrame, key: str, value: str, mask: str, out: str = "z",
                  fill_value: float = 0.0, eps: float = C.ZSCORE_EPS) -> DataFrame:
    """Z-score of the kept values per key (sample std) when at least two
    are kept; masked-out positions and rows with < 2 kept get ``fill_value``."""
    kept = F.col(mask) != 0
    st = [F.avg(F.when(kept, F.col(value))).alias("_mean"), F.stddev_samp(F.when(kept, F.col(value))).alias("_std"),
          F.sum(kept.cast("int")).alias("_n")]
    z = (F.col(value) - F.col("_mean")) / (F.col("_std") + F.lit(eps))
    return (ordered.attach_measured(df, key, st)
              .withColumn(out, F.when(kept & (F.col("_n") >= 2), z).otherwise(F.lit(float(fill_value))))
              .drop("_mean", "_std", "_n"))


def masked_mean(df: DataFrame, key: str, value: str, mask: str, out: str = "masked_mean",
                eps: float = C.MASKED_EPS) -> DataFrame:
    """sum(v * m) / (sum(m) + eps) per key (one row per key)."""
    return df.groupBy(key).agg(
        (F.sum(F.col(value) * F.col(mask)) / (F.sum(F.col(mask)) + F.lit(eps))).alias(out))


def masked_min_max(df: DataFrame, key: str, value: str, mask: str, out: str = "scaled") -> DataFrame:
    """(x - min) / range over kept values per key; zero range -> divide
    by 1; masked-out positions -> 0."""
    kept = F.col(mask) != 0
    st = [F.min(F.when(kept, F.col(value))).alias("_min"), F.max(F.when(kept, F.col(value))).alias("_max")]
    rng = F.col("_max") - F.col("_min")
    rng = F.when(rng == 0, F.lit(1.0)).otherwise(rng)
    return (ordered.attach_measured(df, key, st)
              .withColumn(out, F.when(kept, (F.col(value) - F.col("_min")) / rng).otherwise(F.lit(0.0)))
              .drop("_min", "_max"))
