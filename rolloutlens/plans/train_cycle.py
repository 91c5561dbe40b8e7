"""Entry 1 - one collection pass of the train cycle, as one lazy plan.

prompts/rollouts -> score (A1-A4, A13) -> group statistics (G3) ->
advantage (W1) -> F1 -> F2 -> buffer records. Budget fill, repeat and
shuffle (R2, R5, R6) and the sink (S4) are in :mod:`rolloutlens.operators.batching`
and :mod:`rolloutlens.sources.sinks`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..sources import fixtures as FX
from . import scoring as S


def collection_pass(spark: SparkSession, sf_dir: str, cfg: RunConfig | None = None,
                    rollouts: DataFrame | None = None) -> DataFrame:
    cfg = cfg or RunConfig()
    r = rollouts if rollouts is not None else FX.rollouts(spark, sf_dir)
    scored = S.scored_table(S.score(r, weights=cfg.weights), (*S.GROUP_COLUMNS, "content"))
    kept = S.buffer_rows(scored, cfg.flat_group_std, cfg.advantage_eps)
    return S.to_buffer_records(kept)


def collection_cycle(kept: DataFrame, cfg: RunConfig) -> DataFrame:
    """Entry 1 from the kept rows (with ``content``) on: fill the budget, write
    the buffer rows once, repeat, shuffle; buffer records with their keys,
    ``rep`` and ``shuffle_rank``."""
    from ..operators import batching as B
    from ..session import materialize
    buffer = materialize(B.fill_budget(kept, cfg), "buffer")
    d = B.seeded_shuffle(B.repeat(buffer, cfg.rep_num), ["prompt_idx", "gen_idx", "rep"], cfg.seed)
    completion = F.array(F.struct(F.lit("assistant").alias("role"), F.col("content").alias("content")))
    return d.select("prompt_idx", "gen_idx", "rep", completion.alias("completion"), "advantage", "reward",
                    F.col("gold").alias("label"), "shuffle_rank")


def run_cycles(kept: DataFrame, cfg: RunConfig, out_dir: str, cycles: int, until: int | None = None) -> DataFrame:
    """Entry 1's loop over ``cycles`` cycles, from wherever the run stands: the
    buffers go to ``<out_dir>/buffer`` and then a state row per cycle to
    ``<out_dir>/state``, a folder per call in both. Returns the state table.

    A run that ended early, or whose data have grown, is called again and goes
    on at the last state row's next start: cycles whose buffers were written
    without their state rows are made again, to the same folder (it is named by
    the first of them). Only cycles that
    reach the budget are finished; the records of a short last cycle wait for
    more data. ``until``: the prompts below it are all there (default: those of
    ``kept`` are); the batch that it cuts waits, too."""
    from ..operators import cycles as CY
    from ..sources import readers as RD
    from ..sources import sinks as SK
    spark, state = kept.sparkSession, f"{out_dir}/state"
    done, start = RD.resume_point(spark, state, cfg.start_idx)
    if until is not None:
        kept = kept.filter(F.col("prompt_idx") < until // cfg.prompts_per_batch * cfg.prompts_per_batch)
    if done < cycles:
        now = RunConfig(**{**cfg.__dict__, "start_idx": start})
        batches = CY.kept_batches(kept, now)
        starts = CY.cycle_starts(batches, now, cycles - done).where("to is not null")
        rows = CY.fill_cycles(kept, now, batches=batches, starts=starts)
        shift = lambda d: d.withColumn("cycle", F.col("cycle") + F.lit(done)).withColumn("since", F.lit(done + 1))
        SK.write_by_cycle(shift(rows), f"{out_dir}/buffer")
        SK.write_by_cycle(shift(CY.schedule_of(batches, starts, now)), state)
    return RD.read_state(spark, state)
