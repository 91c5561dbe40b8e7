"""Batching, budget fill, repeat, shuffle and shard assignment.

The collection loop scores ``MAX_NUM_SEQ // G`` prompts at a time and stops
once the kept records reach the budget. Here it is two-phase: kept counts
per batch and per (prompt, chunk) cell (small aggregates) -> prefix sums over
batches and cells (chunked scans, no single-task global window) -> the cells
that begin inside the budget -> positions inside a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import permute
from ..session import materialize
from . import ordered

KEY = "prompt_idx"
POS = "gen_idx"
WHOLE = 1 << 60          # a budget that takes all


def with_batch(df: DataFrame, prompts_per_batch: int, key: str = KEY) -> DataFrame:
    """Batch id = floor(prompt_idx / B) on the absolute index, so a start
    that is not a multiple of B makes the first batch short."""
    return df.withColumn("batch", F.expr(f"`{key}` div {prompts_per_batch}"))


def batch_offsets(kept: DataFrame) -> DataFrame:
    """Per batch: kept rows ``n`` and kept rows in all earlier batches ``before``."""
    cnt = kept.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(0))
    cum = ordered.running_sum(cnt, "_k", "batch", "n", "_cum")
    return cum.select("batch", "n", (F.col("_cum") - F.col("n")).alias("before"))


def fill_budget(kept: DataFrame, cfg: RunConfig, key: str = KEY, pos: str = POS) -> DataFrame:
    """R2: whole batches in order (from ``cfg.start_idx``) until the kept
    count reaches ``cfg.int_num``, then the first ``int_num`` records.

    Adds ``batch`` and ``position`` (1-based place in the buffer). The counts
    per batch are taken first; then only the batches that the buffer needs
    are read again, by a filter on the key that reaches the scan."""
    d = with_batch(kept.filter(F.col(key) >= F.lit(cfg.start_idx)), cfg.prompts_per_batch, key)
    need = materialize(batch_offsets(d).filter(F.col("before") < F.lit(cfg.int_num)).select("batch", "before"), "need")
    if cfg.int_num < WHOLE:
        last = need.agg(F.max("batch")).first()[0]
        d = d.filter(F.col(key) < F.lit(0 if last is None else (last + 1) * cfg.prompts_per_batch))
    return placed(d, need, cfg.int_num, key, pos)


def placed(d: DataFrame, first: DataFrame, int_num: int, key: str = KEY, pos: str = POS, carry: tuple = ()) -> DataFrame:
    """Rows of ``d`` (with ``batch``) that lie in the first ``int_num`` places,
    with ``position``. ``first``: batch, ``before`` (places taken before the
    batch) and ``carry`` columns.

    Rows are counted per (batch, prompt, chunk of generations), then what lies
    before each: a prompt with many generations is ranked chunk by chunk, not
    in one window."""
    d = d.withColumn("_cell", ordered.chunk_of(pos))
    cells = d.groupBy("batch", key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy("batch").orderBy(key, "_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.join(first, "batch").select(
        key, "_cell", *carry, (F.col("before") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_start"))
    starts = starts.filter(F.col("_start") < F.lit(int_num))
    w = Window.partitionBy(key, "_cell").orderBy(pos)
    return (d.join(starts, [key, "_cell"])
             .withColumn("position", F.col("_start") + F.row_number().over(w))
             .filter(F.col("position") <= F.lit(int_num))
             .drop("_start", "_cell"))


def next_start(kept: DataFrame, cfg: RunConfig, key: str = KEY) -> DataFrame:
    """R3 (+ Q15 report): next start index = end of the last used batch;
    when the budget is never met, the end of the data and the shortfall."""
    d = with_batch(kept.filter(F.col(key) >= F.lit(cfg.start_idx)), cfg.prompts_per_batch, key)
    offs = batch_offsets(d).withColumn("_cum", F.col("before") + F.col("n"))
    met = F.col("_cum") >= F.lit(cfg.int_num)
    last = F.coalesce(F.min(F.when(met, F.col("batch"))), F.max("batch"))
    t = offs.agg(last.alias("_last"), F.sum("n").alias("kept_total"))
    return t.select(((F.col("_last") + 1) * F.lit(cfg.prompts_per_batch)).alias("next_start"),
                    F.col("kept_total"),
                    F.greatest(F.lit(0), F.lit(cfg.int_num) - F.col("kept_total")).cast("long").alias("shortfall"))


def wrap_schedule(problems: DataFrame, position: str, n_rows, start: int, count) -> DataFrame:
    """Training indices ``start .. start+count-1`` over a table of
    ``n_rows`` problems, wrapping with ``idx % n``. Each problem row is
    exploded into the epochs it appears in (work grows with the schedule)."""
    p = F.col(position)
    e_lo = F.ceil((F.lit(start) - p) / n_rows)
    e_lo = F.greatest(e_lo, F.lit(0)).cast("long")
    end = F.lit(start) + count            # exclusive; ``count`` may be a Column
    e_hi = F.floor((end - 1 - p) / n_rows).cast("long")
    d = problems.withColumn("_e", F.explode(F.sequence(e_lo, F.greatest(e_hi, e_lo))))
    d = d.withColumn("train_idx", (F.col("_e") * n_rows + p).cast("long"))
    return d.filter((F.col("train_idx") >= start) & (F.col("train_idx") < end)).drop("_e")


def repeat(df: DataFrame, rep_num: int) -> DataFrame:
    """Every record ``rep_num`` times (column ``rep`` = 1..rep_num)."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(rep_num))))


def seeded_shuffle(df: DataFrame, keys, seed: int, out: str = "shuffle_rank") -> DataFrame:
    """A seeded permutation: exact 0-based rank by (md5 of keys and
    seed, keys) - reruns agree, any engine can repeat it; no global sort. The
    rank buckets are the first five hex digits."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    d = df.withColumn("_h", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))))
    bucket = F.conv(F.substring("_h", 1, 5), 16, 10).cast("long")
    return ordered.global_rank(d, ["_h", *keys], out=out, bucket=bucket).drop("_h")


def permuted_shuffle(df: DataFrame, position: str, n: int, seed: int, out: str = "shuffle_rank") -> DataFrame:
    """S3 / R6 for rows that know their dense place (0..n-1): a seeded
    permutation computed inside the row, with no sort and no exchange."""
    return permute.with_permuted(df, position, n, seed, out)


def shard_assignment(df: DataFrame, rank: str, cfg: RunConfig) -> DataFrame:
    """Rank -> (step, accum, device, slot); one optimiser step takes
    per_device_batch x grad_accum x num_devices records."""
    p, a, dv = cfg.per_device_batch, cfg.grad_accum, cfg.num_devices
    r = F.col(rank)
    per_step = p * a * dv
    rem = r % per_step
    return (df.withColumn("step", F.floor(r / per_step).cast("long"))
              .withColumn("accum", F.floor(rem / (p * dv)).cast("int"))
              .withColumn("device", F.floor((rem % (p * dv)) / p).cast("int"))
              .withColumn("slot", (r % p).cast("int")))


def cumulative_batch_metrics(scored: DataFrame, groups: DataFrame, cfg: RunConfig,
                             kept: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """G5 + G6: after every batch, the means over everything collected so far
    (accumulators are not reset between batches): group accuracy, majority,
    reward (over rows), group mean length; plus kept records so far. All of
    them count from ``cfg.start_idx`` on, as the fill does."""
    start = F.col(key) >= F.lit(cfg.start_idx)
    per_prompt = groups.filter(start)
    if not {"mean", "n"} <= set(groups.columns):
        rows = scored.filter(start).groupBy(key).agg(F.avg("reward").alias("mean"), F.count(F.lit(1)).alias("n"))
        per_prompt = per_prompt.join(rows, key, "full_outer")
    if kept is not None:
        per_prompt = per_prompt.join(kept.filter(start).groupBy(key).agg(F.count(F.lit(1)).alias("n_kept")), key, "left")
    else:
        per_prompt = per_prompt.withColumn("n_kept", F.lit(0))
    # everything per prompt, then one aggregate per batch, written: a row per batch
    t = with_batch(per_prompt, cfg.prompts_per_batch, key).groupBy("batch").agg(
        F.sum("acc_mean").alias("s_acc"), F.sum("majority").alias("s_major"), F.sum("mean_length").alias("s_len"),
        F.count("acc_mean").alias("n_groups"), F.sum(F.col("mean") * F.col("n")).alias("s_reward"), F.sum("n").alias("n_rows"),
        F.sum("n_kept").alias("n_kept"))
    t = t.fillna(0, subset=["s_acc", "s_major", "s_len", "n_groups", "s_reward", "n_rows", "n_kept"])
    t = materialize(t, "batches").withColumn("_k", F.lit(0))
    t = ordered.running_sums(t, "_k", "batch",
                             ["s_acc", "s_major", "s_len", "n_groups", "s_reward", "n_rows", "n_kept"], "c_")
    return t.select(
        "batch",
        F.try_divide(F.col("c_s_acc"), F.col("c_n_groups")).alias("acc_ave"),
        F.try_divide(F.col("c_s_major"), F.col("c_n_groups")).alias("acc_major"),
        F.try_divide(F.col("c_s_reward"), F.col("c_n_rows")).alias("reward"),
        F.try_divide(F.col("c_s_len"), F.col("c_n_groups")).alias("length"),
        F.col("c_n_kept").alias("records"))
