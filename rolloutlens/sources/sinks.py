"""Sinks: buffer files, metrics table, shard layout (S4, S8, R7), state of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_buffer(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Overwrite the buffer as JSON lines (UTF-8 kept) or parquet."""
    df.write.mode("overwrite").format(fmt).save(path)


def metrics_long(df: DataFrame, metric_cols, step: str = "step", keys=("run", "phase")) -> DataFrame:
    """Stack metric columns into (run, phase, step, metric, value) rows."""
    m = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                            for c in metric_cols])).alias("m")
    return (df.select(*keys, F.col(step).cast("long").alias("step"), m)
              .select(*keys, "step", "m.metric", "m.value"))


def append_metrics(long: DataFrame, path: str, batch: str | int) -> None:
    """Add metric rows to the metrics table (one write, partitioned by
    run). Rows go to the folder of their ``batch``, which a retry overwrites,
    so nothing is counted twice."""
    (long.select("run", "phase", "step", "metric", "value")
         .write.mode("overwrite").partitionBy("run").parquet(f"{path}/batch={batch}"))


def write_shards(df: DataFrame, path: str) -> None:
    """R7's layout: one folder per optimiser step."""
    df.write.mode("overwrite").partitionBy("step").parquet(path)


def write_by_cycle(df: DataFrame, path: str) -> None:
    """Rows with ``cycle`` and ``since``, the first cycle of the call that makes
    them: a folder per ``since``, so files grow in number with calls and tasks,
    not with cycles. The folder at hand is overwritten, others stay, so a
    retried call's cycles are there once. A file's rows are sorted by cycle."""
    df.sortWithinPartitions("since", "cycle") \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("since").parquet(path)
