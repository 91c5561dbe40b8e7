"""Entry 2 - evaluation as one job: problems -> prompts (P2-P5) -> join the
completions (J1) -> score against the problem's gold (J2, A3, A4, A13) ->
group report (G1, G2, P10) -> run metrics (G4). No batches: the whole test
set is one plan; the trainer's per-batch prints are G6's cumulative view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import groups as G
from ..operators import prompts as P
from . import scoring as S


def evaluate(problems: DataFrame, completions: DataFrame, cfg: RunConfig | None = None,
             adapter: str = "test", key: str = "row_id") -> DataFrame:
    cfg = cfg or RunConfig()
    prompts = P.build_prompts(problems, adapter, "test", cfg.group_size, key)
    joined, _ = P.attach_completions(prompts, completions)
    gold = prompts.filter(F.col("gen_idx") == 0).select("prompt_idx", "gold")
    scored = S.score_with_gold_table(joined.select("prompt_idx", "gen_idx", "content"), gold, cfg.weights)
    scored = S.scored_table(scored)
    report = S.group_report(scored)
    return G.run_metrics(scored, report)
