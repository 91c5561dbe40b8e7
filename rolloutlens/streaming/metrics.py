"""Running metrics inside the stream (ST2).

One query from arrivals to running totals, with one watermark and three
stateful operators in a row: redelivered rows are dropped; the scored rows of
a prompt are held (map state) until all generations are there, and then become
one row of group metrics; those are added to totals kept per shard of the
prompts. Each batch appends the new totals of the shards that it changed, so a
reader has the metrics of all groups so far from one row per shard, and no file
is summed again. Rows are scored by the native plan before they enter state,
so state holds numbers and canonical answers, not texts. Groups that never
complete are let go by a timer and are not counted.

Chained stateful operators run in append mode (Spark allows no other); a row
of totals replaces the shard's earlier ones by its larger number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import RunConfig
from ..plans import scoring as S
from . import collect as ST
from . import state as KS

SHARDS = 64
FIELDS = ("acc", "reward", "length", "canon", "num", "den", "no_gold")
HELD = "acc double, reward double, length double, canon string, num string, den string, no_gold boolean"
GROUP = "shard int, acc double, majority double, length double, reward double, n_rows long"
SUMS = ("s_acc", "s_major", "s_length", "s_reward", "n_rows", "n_groups")
TOTALS = "s_acc double, s_major double, s_length double, s_reward double, n_rows long, n_groups long"


def same_answer(a: tuple, b: tuple) -> bool:
    """A2 on (canonical text, numerator, denominator)."""
    if a[0] is None or b[0] is None:
        return False
    return a[0] == b[0] or (a[1] is not None and b[1] is not None and int(a[1]) * int(b[2]) == int(b[1]) * int(a[2]))


def majority(rows: list[tuple]) -> float:
    """G2 for a group's rows in generation order, as dictionaries of FIELDS."""
    if any(r["no_gold"] for r in rows):
        return 1.0
    best, run, before = (0, 0.0), (0, 0.0), None
    for r in rows:
        answer = (r["canon"], r["num"], r["den"])
        if answer[0] is not None:
            run = (run[0] + 1, run[1]) if before is not None and same_answer(answer, before) else (1, r["acc"])
            best = max(best, run, key=lambda x: x[0])  # of equal runs the earlier
        before = answer
    return best[1]


class GroupMetrics(KS.GroupCollector):
    """A row of metrics for every group that completes."""

    held = HELD

    def _entries(self, pdf: pd.DataFrame) -> Iterator[tuple]:
        clean = pdf[list(FIELDS)].astype(object).where(pdf[list(FIELDS)].notna(), None)
        return map(tuple, clean.itertuples(index=False))

    def _released(self, groups: list[tuple[int, dict]], complete: bool) -> pd.DataFrame:
        out = []
        for prompt, rows in groups if complete else []:
            held = [dict(zip(FIELDS, rows[g])) for g in sorted(rows)]
            mean = lambda c: sum(r[c] for r in held) / len(held)
            out.append((prompt % SHARDS, mean("acc"), majority(held), mean("length"), sum(r["reward"] for r in held), len(held)))
        return pd.DataFrame(out, columns=["shard", "acc", "majority", "length", "reward", "n_rows"]).astype(
            {"shard": "int32", "n_rows": "int64"} | dict.fromkeys(["acc", "majority", "length", "reward"], "float64"))


class RunningTotals(StatefulProcessor):
    """Totals of a shard, appended whenever they change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", TOTALS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = list(self.totals.get() or (0.0, 0.0, 0.0, 0.0, 0, 0))
        for pdf in rows:
            new = [*(float(pdf[c].sum()) for c in ("acc", "majority", "length", "reward")), int(pdf["n_rows"].sum()), len(pdf)]
            total = [a + b for a, b in zip(total, new)]
        self.totals.update(tuple(total))
        yield pd.DataFrame([(key[0], *total)], columns=["shard", *SUMS]).astype({"shard": "int32"})

    def close(self) -> None:
        pass


def running_totals(stream: DataFrame, cfg: RunConfig, watermark: str = "30 days", timeout_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """Stream of arrivals -> stream of totals: shard and SUMS."""
    once = stream.withWatermark("arrival_ts", watermark).dropDuplicatesWithinWatermark(["prompt_idx", "gen_idx"])
    scored = S.score(once, weights=cfg.weights).select(
        "prompt_idx", "gen_idx", "arrival_ts", "acc", "reward", F.length("content").cast("double").alias("length"), F.col("ans.canon").alias("canon"),
        F.col("ans.num").cast("string").alias("num"), F.col("ans.den").cast("string").alias("den"), F.col("gold_ans.canon").isNull().alias("no_gold"))
    groups = ST.by_shard(scored).transformWithStateInPandas(GroupMetrics(cfg.group_size, timeout_ms), GROUP, "append", "EventTime")
    return groups.groupBy("shard").transformWithStateInPandas(RunningTotals(), f"shard int, {TOTALS}", "append", "None")


def start_running_metrics(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, cfg: RunConfig,
                          max_files_per_trigger: int | None = None, available_now: bool = True, watermark: str = "30 days",
                          timeout_ms: int = 30 * 24 * 3600 * 1000, state_partitions: int | None = None):
    """Totals to ``sink_dir``, a folder per batch id, overwritten on retry."""
    totals = running_totals(ST._source(spark, source_dir, max_files_per_trigger), cfg, watermark, timeout_ms)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")
    return KS.with_rocksdb(spark, lambda: ST._run(spark, totals, write_batch, checkpoint_dir, available_now, state_partitions))


def running_metrics(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The metrics over all groups so far (one row), from each shard's last totals."""
    last = spark.read.parquet(sink_dir).groupBy("shard").agg(F.max_by(F.struct(*SUMS), "n_groups").alias("t")).select("t.*")
    return ST.metrics_of(last)
