"""Scoring plans shared by the train cycle and the evaluation.

``score``: rollouts -> parsed answers -> accuracy, format -> weighted reward.
``buffer_rows``: scored rows -> group stats -> advantage -> F1 -> F2.
Both are lazy DataFrame plans; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import groups as G
from ..operators import rewards as R


def score(rollouts: DataFrame, weights: dict | None = None, stutter: bool = False,
          extra_rewards: tuple = ()) -> DataFrame:
    """P7/A1-A4/A13 on a rollout table (prompt_idx, gen_idx, gold, content).

    Adds ``ans``, ``gold_ans``, ``correct``, ``acc``, ``fmt``, ``reward`` and a
    column per further reward; group-aware rewards (A7, user ones) may be
    weighted like any other.
    """
    weights = weights or {"accuracy": C.ACCURACY_WEIGHT, "format": C.FORMAT_WEIGHT}
    d = R.parse_answers(rollouts, stutter=stutter)
    names = list(dict.fromkeys([*weights, *extra_rewards]))
    grouped = [n for n in names if n in R.GROUP_REGISTRY]
    for n in grouped:
        d = R.GROUP_REGISTRY[n](d, out=n)
    cols = R.reward_columns([n for n in names if n not in grouped])
    acc, fmt = R.accuracy_reward(), R.format_reward()
    extra = {n: c for n, c in cols.items() if n not in ("accuracy", "format")}
    d = d.select("*", acc.alias("acc"), fmt.alias("fmt"), *[c.alias(n) for n, c in extra.items()])
    named = {**{n: F.col(n) for n in [*grouped, *extra]}, "accuracy": F.col("acc"), "format": F.col("fmt")}
    return d.select("*", R.weighted_reward(named, weights).alias("reward"))


#: What group work reads: no texts.
GROUP_COLUMNS = ("prompt_idx", "gen_idx", "gold", "ans", "gold_ans", "acc", "reward", "content_length")


def scored_table(scored: DataFrame, columns: tuple = GROUP_COLUMNS) -> DataFrame:
    """The named columns of scored rows, written once (see
    :func:`rolloutlens.session.materialize`) before branching group work."""
    from ..session import materialize
    d = scored.withColumn("content_length", F.length("content"))
    return materialize(d.select(*columns), "scored")


def buffer_rows(scored: DataFrame, threshold: float = C.FLAT_GROUP_STD,
                eps: float = C.ADVANTAGE_EPS) -> DataFrame:
    """W1 + F1 + F2: rows of informative groups with a positive advantage."""
    stats = G.group_stats(scored, reward="reward", acc=None)
    adv = G.with_advantages(scored, stats, eps=eps)
    return G.keep_positive(G.drop_flat_groups(adv, threshold))


def to_buffer_records(kept: DataFrame) -> DataFrame:
    """Buffer record shape: completion messages, advantage, reward, label."""
    completion = F.array(F.struct(F.lit("assistant").alias("role"), F.col("content").alias("content")))
    return kept.select("prompt_idx", "gen_idx", completion.alias("completion"),
                       "advantage", "reward", F.col("gold").alias("label"))


def score_with_gold_table(completions: DataFrame, problems: DataFrame,
                          weights: dict | None = None) -> DataFrame:
    """Completions (prompt_idx, gen_idx, content) joined to one gold per
    prompt. The gold label is parsed once on the problem side, before the
    join; Catalyst/AQE pick the join strategy from measured sizes (the gold
    table grows with the data, so it is never forced to broadcast)."""
    from ..functions import answers as A
    g = A.with_parsed(problems.select("prompt_idx", "gold"), "gold", "gold_ans", gold=True)
    d = A.with_parsed(completions, "content", "ans").join(g, "prompt_idx")
    d = d.withColumn("correct", F.col("gold_ans.canon").isNull()
                     | A.answers_equal(F.col("ans"), F.col("gold_ans")))
    weights = weights or {"accuracy": C.ACCURACY_WEIGHT, "format": C.FORMAT_WEIGHT}
    d = d.withColumn("acc", R.accuracy_reward()).withColumn("fmt", R.format_reward())
    return d.withColumn("reward", R.weighted_reward({"accuracy": F.col("acc"), "format": F.col("fmt")},
                                                    weights))


def group_report(scored: DataFrame) -> DataFrame:
    """G1 + G2 + P10 per group: accuracy mean, majority vote, mean length."""
    length = F.col("content_length") if "content_length" in scored.columns else F.length("content")
    stats = G.group_stats(scored.withColumn("_len", length), reward="reward", acc="acc", length="_len")
    votes = G.majority_run(scored)
    return stats.join(votes, "prompt_idx", "left")
