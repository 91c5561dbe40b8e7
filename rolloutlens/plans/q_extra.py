"""Queries: evaluation entry (entry 2) and user rewards."""

from __future__ import annotations

from ..config import RunConfig
from ..operators import rewards as R
from ..sources import fixtures as FX
from . import oracle as O
from .catalog import r9, register
from .evaluation import evaluate
from .q_groups import majority_sql

EVAL_SQL = f"""{O.ROLLOUTS},
pr AS (SELECT item_id AS prompt_idx, '\\boxed{{' || CAST(item_id AS VARCHAR) || '}}' AS gold FROM benchmark),
j AS (SELECT r.prompt_idx, r.gen_idx, r.content, p.gold FROM rollouts r JOIN pr p USING (prompt_idx)),
p1 AS (SELECT *, {O.parsed_cols("content", "ans")}, {O.parsed_cols("gold", "gold", gold=True)} FROM j),
parsed AS (SELECT *, {O.numeric_cols("ans")}, {O.numeric_cols("gold")} FROM p1),
scored AS (
  SELECT *, acc + fmt AS reward FROM (
    SELECT *, CAST(correct AS DOUBLE) AS acc,
           CAST(CASE WHEN regexp_matches(content, {O.lit(O.FORMAT)}) THEN 1 ELSE 0 END AS DOUBLE) AS fmt
    FROM (SELECT *, (gold_canon IS NULL OR {O.equal("ans", "gold")}) AS correct FROM parsed)))"""


@register("e2_evaluation_metrics", f"""WITH {EVAL_SQL}, {majority_sql()},
gs AS (SELECT prompt_idx, avg(acc) AS acc_mean, avg(length(content)) AS mean_length
       FROM scored GROUP BY prompt_idx)
SELECT {O.r9("avg(acc_mean)")} AS acc_ave, {O.r9("avg(majority)")} AS acc_major,
       {O.r9("avg(mean_length)")} AS length, count(*) AS n_groups,
       (SELECT {O.r9("avg(reward)")} FROM scored) AS reward, (SELECT count(*) FROM scored) AS n_rows
FROM gs JOIN maj USING (prompt_idx)""")
def e2_evaluation_metrics(spark, sf_dir):
    """Entry 2 end to end: benchmark problems as the test set, the document
    rollouts as their completions, G = 8."""
    comp = FX.rollouts(spark, sf_dir).select("prompt_idx", "gen_idx", "content")
    m = evaluate(FX.problems_test(spark, sf_dir), comp, RunConfig(group_size=8))
    return m.select(r9("acc_ave").alias("acc_ave"), r9("acc_major").alias("acc_major"),
                    r9("length").alias("length"), "n_groups", r9("reward").alias("reward"), "n_rows")


def _newline_count(s):
    return s.str.count("\n").astype("float64")


@register("x1_user_reward", f"""WITH {O.ROLLOUTS}
SELECT prompt_idx, gen_idx, CAST(length(content) - length(replace(content, chr(10), '')) AS DOUBLE) AS user_reward
FROM rollouts""")
def x1_user_reward(spark, sf_dir):
    """A user reward registered as a vectorised pandas function (Arrow
    batches), used through the same registry as the built-in rewards."""
    R.register_pandas_reward("newline_count", _newline_count)
    cols = R.reward_columns(["newline_count"])
    return FX.rollouts(spark, sf_dir).select("prompt_idx", "gen_idx", cols["newline_count"].alias("user_reward"))
