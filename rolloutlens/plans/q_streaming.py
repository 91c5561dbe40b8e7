"""Queries: streaming collection (ST1) and running metrics (ST2), each run
to completion with an ``availableNow`` trigger over arrival files staged
from the events rollouts (arrival time = the event timestamp)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RunConfig
from ..session import scratch_path
from ..sources import fixtures as FX
from ..streaming import collect as ST
from ..streaming import metrics as RM
from ..streaming import state as KS
from . import oracle as O
from .catalog import r9, register
from .q_groups import EVENTS, majority_sql

CFG = RunConfig(group_size=8)


#: A generation that never arrives, so that its group stays open.
MISSING = (3, 7)


def _stage(spark, sf_dir):
    """Arrival files of the events rollouts, with rows that are delivered
    twice and one generation that never comes."""
    r = FX.rollouts_events(spark, sf_dir)
    ts = FX.read_table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 8).cast("long").alias("prompt_idx"),
        (F.col("event_id") % 8).cast("int").alias("gen_idx"), F.col("ts").alias("arrival_ts"))
    src = scratch_path(spark, "arrivals")
    r = r.join(ts, ["prompt_idx", "gen_idx"]).where(~((F.col("prompt_idx") == MISSING[0]) & (F.col("gen_idx") == MISSING[1])))
    again = F.when((F.col("prompt_idx") + F.col("gen_idx")) % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    ST.stage_arrivals(r.withColumn("_n", F.explode(again)).drop("_n"), src)
    return src


ST1_SQL = f"""WITH {EVENTS},
adv AS (SELECT *, (reward - mean) / (std + 0.0001) AS advantage
        FROM (SELECT *, avg(reward) OVER (PARTITION BY prompt_idx) AS mean,
                     stddev_pop(reward) OVER (PARTITION BY prompt_idx) AS std FROM scored))
SELECT prompt_idx, gen_idx, {O.r9('advantage')} AS advantage, reward, gold AS label
FROM adv WHERE std >= 0.1 AND advantage > 0 AND prompt_idx <> {MISSING[0]}"""


@register("st1_streaming_buffer", ST1_SQL)
def st1_streaming_buffer(spark, sf_dir):
    """ST1: the streamed buffer equals the batch buffer (F2) of the groups that completed."""
    src = _stage(spark, sf_dir)
    sink, ckpt = scratch_path(spark, "st1-sink"), scratch_path(spark, "st1-ckpt")
    q = ST.start_collection(spark, src, sink, ckpt, CFG)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("prompt_idx", "gen_idx", r9("advantage").alias("advantage"), "reward", "label")


OPEN_SQL = f"""SELECT CAST({MISSING[0]} AS BIGINT) AS prompt_idx, count(*) AS n
FROM events WHERE event_id // 8 = {MISSING[0]} AND event_id % 8 <> {MISSING[1]} HAVING count(*) > 0
UNION ALL SELECT event_id // 8, count(*) FROM events WHERE event_id // 8 <> {MISSING[0]} GROUP BY 1 HAVING count(*) < 8"""


@register("st1_open_groups", OPEN_SQL)
def st1_open_groups(spark, sf_dir):
    """ST1: groups still open when the stream has ended."""
    src = _stage(spark, sf_dir)
    sink, ckpt = scratch_path(spark, "st1-sink"), scratch_path(spark, "st1-ckpt")
    ST.start_collection(spark, src, sink, ckpt, CFG).awaitTermination()
    return ST.open_groups(spark, src, sink)


@register("st1_keyed_state", ST1_SQL)
def st1_keyed_state(spark, sf_dir):
    """ST1 with a map state per group and timers (transformWithState): the same buffer."""
    src = _stage(spark, sf_dir)
    sink, ckpt = scratch_path(spark, "st1-sink"), scratch_path(spark, "st1-ckpt")
    KS.start_collection(spark, src, sink, ckpt, CFG).awaitTermination()
    return spark.read.parquet(sink).select("prompt_idx", "gen_idx", r9("advantage").alias("advantage"), "reward", "label")


@register("st1_open_from_state", OPEN_SQL)
def st1_open_from_state(spark, sf_dir):
    """ST1: groups still open when the stream has ended, read from its state alone."""
    src = _stage(spark, sf_dir)
    sink, ckpt = scratch_path(spark, "st1-sink"), scratch_path(spark, "st1-ckpt")
    KS.start_collection(spark, src, sink, ckpt, CFG).awaitTermination()
    return KS.open_groups(spark, ckpt)


ST2_SQL = f"""WITH {EVENTS}, {majority_sql()},
done AS (SELECT * FROM scored WHERE prompt_idx <> {MISSING[0]}),
gs AS (SELECT prompt_idx, avg(acc) AS acc_mean, avg(length(content)) AS mean_length FROM done GROUP BY prompt_idx HAVING count(*) = 8)
SELECT {O.r9('avg(acc_mean)')} AS acc_ave, {O.r9('avg(majority)')} AS acc_major, {O.r9('avg(mean_length)')} AS length,
       (SELECT {O.r9('avg(reward)')} FROM done SEMI JOIN gs USING (prompt_idx)) AS reward, count(*) AS n_groups,
       (SELECT count(*) FROM done SEMI JOIN gs USING (prompt_idx)) AS n_rows
FROM gs JOIN maj USING (prompt_idx)"""


@register("st2_running_metrics", ST2_SQL)
def st2_running_metrics(spark, sf_dir):
    """ST2: running metrics after the last trigger equal G4 of the complete groups."""
    src = _stage(spark, sf_dir)
    sink, ckpt = scratch_path(spark, "st2-sink"), scratch_path(spark, "st2-ckpt")
    ST.start_running_metrics(spark, src, sink, ckpt, CFG).awaitTermination()
    m = ST.running_metrics(spark, sink)
    return m.select(*[r9(c).alias(c) for c in ("acc_ave", "acc_major", "length", "reward")], "n_groups", "n_rows")


@register("st2_stream_totals", ST2_SQL)
def st2_stream_totals(spark, sf_dir):
    """ST2 inside the stream: group release and running totals as chained stateful operators."""
    src = _stage(spark, sf_dir)
    sink, ckpt = scratch_path(spark, "st2-sink"), scratch_path(spark, "st2-ckpt")
    RM.start_running_metrics(spark, src, sink, ckpt, CFG).awaitTermination()
    m = RM.running_metrics(spark, sink)
    return m.select(*[r9(c).alias(c) for c in ("acc_ave", "acc_major", "length", "reward")], "n_groups", "n_rows")
