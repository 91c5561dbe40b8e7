"""Streaming collection (ST1) and running metrics (ST2).

ST1: completions arrive as files (prompt_idx, gen_idx, gold, content,
arrival_ts). Redelivered rows are dropped by ``dropDuplicatesWithinWatermark``
on (prompt_idx, gen_idx), so they can neither complete a group nor release it
twice. Prompts are spread over ``SHARDS`` keys, so a batch calls Python once per
shard and not once per prompt. ``applyInPandasWithState`` keyed by shard then
holds the rows of unfinished groups (at most G per prompt) and releases a group
once all G generations are in; an event-time timeout, the shard's earliest,
releases groups that will never complete, flagged ``complete = False``, so
state cannot grow without bound. A shard's open rows are one state value,
written again when one of its prompts gets a row.
Each micro-batch's released rows are written once, then scored with the same
native plan as the batch path and put into the buffer folder, one sub-folder
per batch id, overwritten on retry (idempotent). Groups that are still open
when a run ends are reported by :func:`open_groups`.

ST2: running metrics (G4: group accuracy, majority, reward, length) as sums
per micro-batch of released groups, one row per batch id, overwritten on
retry; the running values are the sums' quotients.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import schemas
from ..config import RunConfig
from ..plans import scoring as S

STATE_SCHEMA = "gen_idx array<int>, gold array<string>, content array<string>, max_ts long"
SHARD_STATE = "prompt_idx array<long>, gen_idx array<int>, gold array<string>, content array<string>, max_ts array<long>"
SHARDS = 4096
OUT_SCHEMA = "prompt_idx long, gen_idx int, gold string, content string, complete boolean"
SOURCE_SCHEMA = T.StructType(schemas.ROLLOUTS.fields + [T.StructField("arrival_ts", T.TimestampType())])


def _release(groups: list[tuple[int, dict]], complete: bool) -> pd.DataFrame:
    """The rows of groups: prompt -> (gen_idx -> (gold, content))."""
    out = pd.DataFrame([(p, g, *entry, complete) for p, rows in groups for g, entry in rows.items()],
                       columns=["prompt_idx", "gen_idx", "gold", "content", "complete"])
    return out.astype({"prompt_idx": "int64", "gen_idx": "int32", "complete": "bool"})


def _millis(arrival: pd.Series) -> pd.Series:
    return arrival.astype("datetime64[ns]").astype("int64") // 1_000_000


def group_collector(group_size: int, timeout_ms: int):
    """State function of one prompt: buffer its rows until it has ``group_size``."""

    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        k = int(key[0])
        if state.hasTimedOut:
            gen, gold, content, _ = state.get
            state.remove()
            yield _release([(k, dict(zip(gen, zip(gold, content))))], False)
            return
        rows, max_ts = {}, 0
        if state.exists:
            gen, gold, content, max_ts = state.get
            rows = dict(zip(gen, zip(gold, content)))
        for pdf in pdfs:
            for g, s, c in zip(pdf["gen_idx"], pdf["gold"], pdf["content"]):
                rows.setdefault(int(g), (s, c))  # a row beyond the watermark may come again
            max_ts = max(max_ts, int(_millis(pdf["arrival_ts"]).max()))
        if len(rows) >= group_size:
            state.remove()
            yield _release([(k, rows)], True)
        else:
            state.update((list(rows), [s for s, _ in rows.values()], [c for _, c in rows.values()], max_ts))
            state.setTimeoutTimestamp(max_ts + timeout_ms)

    return fn


def shard_collector(group_size: int, timeout_ms: int):
    """State function of a shard of prompts: what :func:`group_collector` does
    for one, for all of them in one call. The state holds the rows of the open
    groups; the shard's timeout is that of the earliest of them."""

    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, last = {}, {}
        if state.exists:
            for p, g, s, c, t in zip(*state.get):
                held.setdefault(p, {})[g] = (s, c)
                last[p] = t
        if not state.hasTimedOut:
            for pdf in pdfs:
                for p, g, s, c, t in zip(pdf["prompt_idx"].tolist(), pdf["gen_idx"].tolist(), pdf["gold"], pdf["content"],
                                         _millis(pdf["arrival_ts"]).tolist()):
                    held.setdefault(p, {}).setdefault(g, (s, c))  # a row beyond the watermark may come again
                    last[p] = max(last.get(p, 0), t)
            done = [p for p, rows in held.items() if len(rows) >= group_size]
            if done:
                yield _release([(p, held.pop(p)) for p in done], True)
        now = state.getCurrentWatermarkMs()
        over = [p for p in held if last[p] + timeout_ms < now]
        if over:
            yield _release([(p, held.pop(p)) for p in over], False)
        if held:
            rows = [(p, g, s, c, last[p]) for p, group in held.items() for g, (s, c) in group.items()]
            state.update(tuple(map(list, zip(*rows))))
            state.setTimeoutTimestamp(max(min(last[p] for p in held) + timeout_ms, now + 1))
        elif state.exists:
            state.remove()

    return fn


def by_shard(rows: DataFrame):
    """Rows of prompts, grouped by the shard of their prompt."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("prompt_idx"), F.lit(SHARDS)).cast("int")).groupBy("shard")


def released_groups(stream: DataFrame, cfg: RunConfig, watermark: str = "30 days",
                    timeout_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """ST1 first half: stream of released groups (complete or timed out)."""
    once = stream.withWatermark("arrival_ts", watermark).dropDuplicatesWithinWatermark(["prompt_idx", "gen_idx"])
    return by_shard(once).applyInPandasWithState(shard_collector(cfg.group_size, timeout_ms), OUT_SCHEMA, SHARD_STATE, "append",
                                                 GroupStateTimeout.EventTimeTimeout)


def _start_with_partitions(spark: SparkSession, n: int | None, start):
    """Start a stream whose shuffles (and state store) use ``n`` partitions.

    A stream copies the session's settings when it starts, and its state
    partition count is then fixed by the checkpoint, so the setting is
    applied for the start only and the caller's session is left unchanged.
    Default: the cluster's parallelism (total cores)."""
    if n is None:
        try:
            n = spark.sparkContext.defaultParallelism
        except Exception:  # noqa: BLE001 - Spark Connect
            return start()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        return start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def _source(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None) -> DataFrame:
    r = spark.readStream.schema(SOURCE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def _run(spark: SparkSession, released: DataFrame, write_batch, checkpoint_dir: str, available_now: bool, state_partitions: int | None):
    w = released.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return _start_with_partitions(spark, state_partitions, w.start)


def _written_once(batch: DataFrame, path: str) -> DataFrame:
    """The batch's rows as a table: later branches do not run the state function again."""
    batch.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.parquet(path)


def start_collection(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                     cfg: RunConfig, max_files_per_trigger: int | None = None, available_now: bool = True,
                     watermark: str = "30 days", timeout_ms: int = 30 * 24 * 3600 * 1000,
                     state_partitions: int | None = None, released=released_groups):
    """ST1: file source -> released groups -> score -> F1/F2 -> buffer folder.

    All released rows are under ``<sink>/_released`` (hidden from readers of
    the buffer); groups released by the timeout are not scored and reported
    under ``<sink>/_incomplete``."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = _written_once(batch, f"{sink_dir}/_released/batch_id={batch_id}")
        complete = rows.filter(F.col("complete")).drop("complete")
        scored = S.scored_table(S.score(complete, weights=cfg.weights), ("prompt_idx", "gen_idx", "gold", "reward"))
        kept = S.buffer_rows(scored, cfg.flat_group_std, cfg.advantage_eps)
        (kept.select("prompt_idx", "gen_idx", "advantage", "reward", F.col("gold").alias("label"))
             .write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}"))
        (rows.filter(~F.col("complete")).select("prompt_idx", "gen_idx")
             .write.mode("overwrite").parquet(f"{sink_dir}/_incomplete/batch_id={batch_id}"))

    groups = released(_source(spark, source_dir, max_files_per_trigger), cfg, watermark, timeout_ms)
    return _run(spark, groups, write_batch, checkpoint_dir, available_now, state_partitions)


def open_groups(spark: SparkSession, source_dir: str, sink_dir: str) -> DataFrame:
    """Groups with arrivals that no batch has released yet: prompt_idx, n
    (different generations so far). A batch report, run when a stream has
    ended or beside it."""
    seen = spark.read.schema(SOURCE_SCHEMA).parquet(source_dir).select("prompt_idx", "gen_idx").distinct()
    released = spark.read.parquet(f"{sink_dir}/_released").select("prompt_idx").distinct()
    return seen.join(released, "prompt_idx", "left_anti").groupBy("prompt_idx").agg(F.count(F.lit(1)).alias("n"))


def start_running_metrics(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                          cfg: RunConfig, max_files_per_trigger: int | None = None, available_now: bool = True,
                          watermark: str = "30 days", timeout_ms: int = 30 * 24 * 3600 * 1000,
                          state_partitions: int | None = None):
    """ST2: sums of the G4 metrics per micro-batch of complete groups; read
    them with :func:`running_metrics`."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = S.scored_table(S.score(batch.filter(F.col("complete")).drop("complete"), weights=cfg.weights))
        groups = S.group_report(scored).agg(
            F.sum("acc_mean").alias("s_acc"), F.sum("majority").alias("s_major"), F.sum("mean_length").alias("s_length"),
            F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("mean") * F.col("n")).alias("s_reward"), F.sum("n").alias("n_rows"))
        groups.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    released = released_groups(_source(spark, source_dir, max_files_per_trigger), cfg, watermark, timeout_ms)
    return _run(spark, released, write_batch, checkpoint_dir, available_now, state_partitions)


def running_metrics(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The metrics over everything released so far (one row)."""
    return metrics_of(spark.read.parquet(sink_dir))


def metrics_of(sums: DataFrame) -> DataFrame:
    """The means from rows of sums."""
    t = sums.agg(*[F.sum(c).alias(c) for c in ("s_acc", "s_major", "s_length", "n_groups", "s_reward", "n_rows")])
    return t.select(F.try_divide("s_acc", "n_groups").alias("acc_ave"), F.try_divide("s_major", "n_groups").alias("acc_major"),
                    F.try_divide("s_length", "n_groups").alias("length"), F.try_divide("s_reward", "n_rows").alias("reward"),
                    "n_groups", "n_rows")


def stage_arrivals(rollouts_with_ts: DataFrame, source_dir: str, files: int | None = None) -> None:
    """Write completions as arrival files ordered by arrival time; their
    number follows the input's partitioning unless given."""
    d = rollouts_with_ts.repartitionByRange(files, "arrival_ts") if files else rollouts_with_ts.repartitionByRange("arrival_ts")
    d.write.mode("overwrite").parquet(source_dir)
