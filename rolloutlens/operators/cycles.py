"""All collection cycles of a run (R2, R3, U2) at once.

A cycle takes whole batches from its start on until ``int_num`` records are
kept, and the next cycle starts at the end of its last batch. Where a cycle ends
follows from its start alone, so every batch gets a pointer: to the batch that
would begin the next cycle, if a cycle began here. The cycles of a run are the
path of these pointers from the first batch. The path is found by pointer
doubling: tables of 2, 4, 8 ... pointers at once, each made from the one before
by a join with itself, and the part of the path known so far doubles with each.
So 200 cycles, or any number, take about eight small joins, and no cycle is
waited for on the driver.

A batch is known by the number of records kept before it (unique, as only
batches with kept records count). The pointer of a batch that has ``before``
records before it is found where the record ``before + int_num`` lies: in the
batch whose records cover that number. Both sides meet on buckets of record
numbers, so this is an equi-join whatever the batch sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..session import materialize
from . import batching as B
from . import ordered


def kept_batches(kept: DataFrame, cfg: RunConfig, key: str = B.KEY) -> DataFrame:
    """batch, n, before, upto: kept records of a batch, before it, and up to its
    end, from ``cfg.start_idx`` on; written once (a row per batch)."""
    d = B.with_batch(kept.filter(F.col(key) >= F.lit(cfg.start_idx)), cfg.prompts_per_batch, key)
    return materialize(B.batch_offsets(d).withColumn("upto", F.col("before") + F.col("n")), "batches")


def pointers(batches: DataFrame, int_num: int) -> DataFrame:
    """at, to, last: a cycle that begins with the batch that has ``at`` records
    before it ends with batch ``last``, and ``to`` records lie before the next.
    Batches from which the data end before the budget have no pointer."""
    rows, total = batches.agg(F.count(F.lit(1)), F.sum("n")).first()
    width = max(1, 4 * (total or 0) // max(rows, 1))  # a few batches to a bucket
    ends = batches.select(F.col("batch").alias("last"), F.col("before").alias("_from"), F.col("upto").alias("to")) \
        .withColumn("_bucket", F.explode(F.sequence(F.expr(f"(_from + 1) div {width}"), F.expr(f"to div {width}"))))
    wanted = (F.col("before") + F.lit(int_num)).alias("_record")
    starts = batches.select(F.col("before").alias("at"), wanted).withColumn("_bucket", F.expr(f"_record div {width}"))
    return starts.join(ends, "_bucket").where("_record > _from and _record <= to").select("at", "to", "last")


def _path(batches: DataFrame, jump: DataFrame, cycles: int) -> DataFrame:
    """cycle (from 1), at, prev: the cycle's first batch and the last one of the cycle before."""
    first = batches.where("before = 0").select(F.lit(1).cast("long").alias("cycle"), F.col("before").alias("at"),
                                               F.lit(None).cast("long").alias("prev"))
    path, reach = first, 1
    while reach < cycles:
        jump = materialize(jump, f"jump{reach}")
        ahead = path.join(jump, "at").select((F.col("cycle") + reach).alias("cycle"), F.col("to").alias("at"), F.col("last").alias("prev"))
        path = materialize(path.unionByName(ahead), f"path{reach}")
        # two jumps in one: the second begins where the first leads to
        second = jump.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("last").alias("_last"))
        jump = jump.join(second, "to").select("at", F.col("_to").alias("to"), F.col("_last").alias("last"))
        reach *= 2
    return path.where(F.col("cycle") <= cycles)


def cycle_starts(batches: DataFrame, cfg: RunConfig, cycles: int | None = None) -> DataFrame:
    """cycle, at, prev, and of the cycle's end: to, last (null where the data
    end first). At most ``cycles`` of them; all, if not given."""
    total = batches.agg(F.sum("n")).first()[0] or 0
    most = -(-total // cfg.int_num)  # each but the last takes int_num records or more
    jump = materialize(pointers(batches, cfg.int_num), "pointers")
    path = _path(batches, jump, min(most, cycles) if cycles is not None else most)
    # a path that ends with the data leads to no batch
    path = path.join(batches.select(F.col("before").alias("at")), "at")
    return path.join(jump, "at", "left")


def cycle_schedule(kept: DataFrame, cfg: RunConfig, cycles: int | None = None, key: str = B.KEY) -> DataFrame:
    """R2 + R3 for all cycles: cycle (from 1), start_idx, next_start, kept
    (records of its whole batches) and shortfall, from ``cfg.start_idx`` on.

    The last cycle of the data may fall short: its next start is the end of
    the last batch with kept records. No kept records: no cycle."""
    return schedule_of(batches := kept_batches(kept, cfg, key), cycle_starts(batches, cfg, cycles), cfg)


def schedule_of(batches: DataFrame, starts: DataFrame, cfg: RunConfig) -> DataFrame:
    total, top = batches.agg(F.sum("n"), F.max("batch")).first()
    after = lambda batch: (batch + 1) * F.lit(cfg.prompts_per_batch)
    kept = (F.coalesce(F.col("to"), F.lit(total)) - F.col("at")).cast("long")
    return starts.select(
        "cycle", F.coalesce(after(F.col("prev")), F.lit(cfg.start_idx)).cast("long").alias("start_idx"),
        after(F.coalesce(F.col("last"), F.lit(top))).cast("long").alias("next_start"), kept.alias("kept"),
        F.greatest(F.lit(0), F.lit(cfg.int_num) - kept).cast("long").alias("shortfall"))


def fill_cycles(kept: DataFrame, cfg: RunConfig, cycles: int | None = None, key: str = B.KEY, pos: str = B.POS,
                batches: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    """U2 over all cycles: every record that a cycle's buffer takes, with
    ``cycle``, ``batch`` and ``position`` (1-based place in its buffer)."""
    batches = kept_batches(kept, cfg, key) if batches is None else batches
    starts = cycle_starts(batches, cfg, cycles) if starts is None else starts
    marked = batches.join(starts.select("cycle", F.col("at").alias("before"), F.col("at").alias("_at"), F.col("to").alias("_to")), "before", "left")
    # the cycle that a batch is in: the last one that has begun; numbers rise with the batches
    marked = marked.withColumn("_k", F.lit(0)).withColumn("_begun", F.when(F.col("cycle").isNotNull(), F.struct("_at", "cycle", "_to")))
    held = ordered.running_max(marked.drop("cycle"), "_k", "batch", "_begun", "_in").where("_in is not null and (_in._to is null or before < _in._to)")
    first = held.select("batch", "_in.cycle", (F.col("before") - F.col("_in._at")).alias("before"))
    d = B.with_batch(kept.filter(F.col(key) >= F.lit(cfg.start_idx)), cfg.prompts_per_batch, key)
    return B.placed(d, first, cfg.int_num, key, pos, carry=("cycle",))
