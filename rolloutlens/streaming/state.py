"""Streaming collection (ST1) on ``transformWithState``.

Prompts are spread over ``collect.SHARDS`` keys, so a batch calls the processor once per
shard and not once per prompt. The rows of an open group are entries of a map
state, one per generation, so an arrival writes its own entry and not the
group's rows again; a second map says of every open group when its time is up
and which generations it holds. A group that is complete within one batch
never touches the maps. Groups that never complete are released, marked
incomplete, ``timeout_ms`` after their last arrival, by an event-time timer of
the shard, set to the earliest of its open groups. What is open can be asked
from the state alone (:func:`open_groups`), through Spark's state data source; no
arrival is read again. The rest (sinks, redelivered rows, scoring of a batch) is
as in :mod:`rolloutlens.streaming.collect`.

State lives in RocksDB under the stream's checkpoint; the store is set for the
stream's own copy of the session settings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import RunConfig
from . import collect as ST

ROWS, DEADLINE = "rows", "deadline"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["prompt_idx", "gen_idx", "gold", "content", "complete"]


class GroupCollector(StatefulProcessor):
    """Holds the rows of a shard's prompts until all generations are there or time is up."""

    held = "gold string, content string"

    def __init__(self, group_size: int, timeout_ms: int):
        self.group_size, self.timeout_ms = group_size, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState(ROWS, "prompt_idx long, gen_idx int", self.held)
        self.deadline = handle.getMapState(DEADLINE, "prompt_idx long", "at long, gens array<int>")

    def _entries(self, pdf: pd.DataFrame) -> Iterator[tuple]:
        return zip(pdf["gold"], pdf["content"])

    def _released(self, groups: list[tuple[int, dict]], complete: bool) -> pd.DataFrame:
        out = pd.DataFrame([(p, g, *rows[g], complete) for p, rows in groups for g in sorted(rows)], columns=COLUMNS)
        return out.astype({"prompt_idx": "int64", "gen_idx": "int32", "complete": "bool"})

    def _open(self) -> dict[int, tuple[int, list[int]]]:
        """Of the shard's open groups: when time is up, generations so far."""
        return {k[0]: (v[0], list(v[1])) for k, v in self.deadline.iterator()}

    def _taken(self, prompt: int, gens: list[int]) -> dict:
        """An open group's rows, which leave the state."""
        rows = {}
        for g in gens:
            rows[g] = tuple(self.rows.getValue((prompt, g)))
            self.rows.removeKey((prompt, g))
        self.deadline.removeKey((prompt,))
        return rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, last = {}, {}
        for pdf in rows:
            at = pdf["arrival_ts"].astype("datetime64[ns]").astype("int64") // 1_000_000
            for p, g, t, entry in zip(pdf["prompt_idx"].tolist(), pdf["gen_idx"].tolist(), at.tolist(), self._entries(pdf)):
                new.setdefault(p, {}).setdefault(g, entry)  # the first arrival of a generation stays
                last[p] = max(last.get(p, 0), t)
        held = self._open()
        timer = min((at for at, _ in held.values()), default=None)
        done = []
        for p, got in new.items():
            at, gens = held.get(p, (0, []))
            fresh = [g for g in got if g not in gens]
            if len(gens) + len(fresh) >= self.group_size:
                done.append((p, got | self._taken(p, gens) if gens else got))
                held.pop(p, None)
                continue
            for g in fresh:
                self.rows.updateValue((p, g), got[g])
            held[p] = max(last[p] + self.timeout_ms, at), gens + fresh
            if fresh or held[p][0] != at:
                self.deadline.updateValue((p,), held[p])
        self._set_timer(timer, held)
        if done:
            yield self._released(done, True)

    def _set_timer(self, before: int | None, held: dict) -> None:
        due = min((at for at, _ in held.values()), default=None)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        held = self._open()
        over = [p for p, (at, _) in held.items() if at < now or at <= fired]
        groups = [(p, self._taken(p, held.pop(p)[1])) for p in over]
        self._set_timer(None, held)  # the one that fired is gone
        if groups:
            yield self._released(groups, False)

    def close(self) -> None:
        pass


def released_groups(stream: DataFrame, cfg: RunConfig, watermark: str = "30 days", timeout_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """Stream of released groups (complete or timed out), a row per generation."""
    once = stream.withWatermark("arrival_ts", watermark).dropDuplicatesWithinWatermark(["prompt_idx", "gen_idx"])
    return ST.by_shard(once).transformWithStateInPandas(GroupCollector(cfg.group_size, timeout_ms), ST.OUT_SCHEMA, "append", "EventTime")


def start_collection(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, cfg: RunConfig,
                     max_files_per_trigger: int | None = None, available_now: bool = True, watermark: str = "30 days",
                     timeout_ms: int = 30 * 24 * 3600 * 1000, state_partitions: int | None = None):
    """As :func:`rolloutlens.streaming.collect.start_collection`, to the same folders."""
    return with_rocksdb(spark, lambda: ST.start_collection(
        spark, source_dir, sink_dir, checkpoint_dir, cfg, max_files_per_trigger, available_now, watermark, timeout_ms, state_partitions,
        released=released_groups))


def with_rocksdb(spark: SparkSession, start):
    """Start a stream whose state is in RocksDB; the session's own setting stays."""
    old = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.unset(STORE) if old is None else spark.conf.set(STORE, old)


def open_groups(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """Groups in the state after the last batch: prompt_idx, n (generations so far)."""
    operators = spark.read.format("state-metadata").load(checkpoint_dir)
    number = operators.where(F.lower("operatorName").startswith("transformwithstate")).agg(F.max("operatorId")).first()[0]
    rows = spark.read.format("statestore").option("operatorId", number).option("stateVarName", ROWS).load(checkpoint_dir)
    return rows.groupBy(F.col("user_map_key.prompt_idx").alias("prompt_idx")).agg(F.count(F.lit(1)).alias("n"))
