"""Reward columns over the rollout table.

A rollout table has one row per completion: ``prompt_idx``, ``gen_idx``,
``gold`` (label text) and ``content`` (last message). :func:`parse_answers`
adds the parsed answer and gold structs once; the rewards then are plain
column arithmetic. Group-aware rewards (A7) use a per-group aggregate joined
back, never a whole-group window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import answers as A
from ..functions import text as TX

KEY = "prompt_idx"
POS = "gen_idx"


def parse_answers(df: DataFrame, content: str = "content", gold: str = "gold",
                  stutter: bool = False) -> DataFrame:
    """Add ``ans`` and ``gold_ans`` structs (canon, num, den) and ``correct``.

    ``correct`` follows A3: an unparseable gold counts every answer correct.
    With ``stutter=True`` the content first goes through P8.
    """
    text = F.col(content)
    if stutter:
        df = df.withColumn(content, TX.remove_stutter(text))
    d = A.with_parsed(A.with_parsed(df, content, "ans"), gold, "gold_ans", gold=True)
    return d.select("*", (F.col("gold_ans.canon").isNull()
                          | A.answers_equal(F.col("ans"), F.col("gold_ans"))).alias("correct"))


def accuracy_reward() -> Column:
    """A3: 1.0 / 0.0 per completion (needs :func:`parse_answers`)."""
    return F.col("correct").cast("double")


def format_reward(content: str = "content") -> Column:
    return TX.format_reward(F.col(content))


def weighted_reward(rewards: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of reward * weight over the weight map."""
    total = None
    for name, w in weights.items():
        term = rewards[name] * F.lit(float(w))
        total = term if total is None else total + term
    return total


def length_reward(df: DataFrame, content: str = "content", key: str = KEY,
                  out: str = "len_reward") -> DataFrame:
    """lambda = 0.5 - (len - min)/(max - min) inside the group; correct
    -> lambda, wrong -> min(0, lambda); all lengths equal -> 0."""
    from . import ordered
    d = df.withColumn("_len", F.length(F.col(content)))
    stats = d.groupBy(key).agg(F.min("_len").alias("_min"), F.max("_len").alias("_max"))
    d = ordered.attach(d, stats, key, POS)
    lam = F.lit(0.5) - (F.col("_len") - F.col("_min")) / (F.col("_max") - F.col("_min"))
    r = (F.when(F.col("_max") == F.col("_min"), F.lit(0.0))
          .when(F.col("correct"), lam)
          .otherwise(F.least(F.lit(0.0), lam)))
    return d.withColumn(out, r).drop("_len", "_min", "_max")


def cosine_reward(content: str = "content", min_wrong: float = C.COSINE_MIN_WRONG,
                  max_wrong: float = C.COSINE_MAX_WRONG, min_correct: float = C.COSINE_MIN_CORRECT,
                  max_correct: float = C.COSINE_MAX_CORRECT, max_len: int = C.COSINE_MAX_LEN,
                  clamp: bool = False) -> Column:
    """Lo + 0.5 (hi - lo)(1 + cos(pi len / max_len)); wrong answers swap
    the wrong bounds; unparseable gold -> 1.0; not clamped past max_len
    unless ``clamp``."""
    length = F.length(F.col(content)).cast("double")
    if clamp:
        length = F.least(length, F.lit(float(max_len)))
    cosine = F.cos(length / F.lit(float(max_len)) * F.lit(math.pi))
    lo = F.when(F.col("correct"), F.lit(min_correct)).otherwise(F.lit(max_wrong))
    hi = F.when(F.col("correct"), F.lit(max_correct)).otherwise(F.lit(min_wrong))
    r = lo + F.lit(0.5) * (hi - lo) * (F.lit(1.0) + cosine)
    return F.when(F.col("gold_ans.canon").isNull(), F.lit(1.0)).otherwise(r)


def repetition_reward(content: str = "content", ngram_size: int = 3,
                      max_penalty: float = -1.0) -> Column:
    """A9 (see :func:`rolloutlens.functions.text.repetition_penalty`)."""
    return TX.repetition_penalty(F.col(content), ngram_size, max_penalty)


def code_pass_rate(cases: DataFrame, key: str = "completion_id") -> DataFrame:
    """A11 (re-aimed): pass rate per completion over already executed cases.

    A case passes iff return code 0 and trimmed stdout equals trimmed expected
    output. A plain grouped average: partial aggregation makes hot
    completions cheap.
    """
    passed = ((F.col("returncode") == 0)
              & (F.trim(F.col("stdout")) == F.trim(F.col("expected"))))
    return cases.groupBy(key).agg(
        F.avg(F.when(passed, 1.0).otherwise(0.0)).alias("pass_rate"),
        F.count(F.lit(1)).alias("n_cases"))


# -- registry (X1) ----------------------------------------------------------

RewardFactory = Callable[..., Column]

REGISTRY: dict[str, RewardFactory] = {
    "accuracy": lambda **kw: accuracy_reward(),
    "format": lambda content="content", **kw: format_reward(content),
    "tag_count": lambda content="content", **kw: TX.tag_count_reward(F.col(content)),
    "reasoning_steps": lambda content="content", **kw: TX.reasoning_steps_reward(F.col(content)),
    "cosine": lambda content="content", **kw: cosine_reward(content, **kw),
    "repetition": lambda content="content", **kw: repetition_reward(content, **kw),
    "code_format": lambda content="content", language="python", **kw:
        TX.code_format_reward(F.col(content), language),
}


#: Rewards that need the whole group: DataFrame -> DataFrame with the column ``out``.
GROUP_REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "length": length_reward,
}


def register_group_reward(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a group-aware reward: ``fn(df, out=name)`` over parsed rollouts
    (content, gold, correct, all of a prompt's completions) adds ``out``."""
    GROUP_REGISTRY[name] = fn


def register_reward(name: str, factory: RewardFactory) -> None:
    """Add a reward: a factory returning a Column over the rollout table."""
    REGISTRY[name] = factory


def register_pandas_reward(name: str, fn, input_cols=("content",)) -> None:
    """Register a vectorised user reward (pandas Series -> Series).

    Runs through Arrow batches (``pandas_udf``); built-in rewards never take
    this path.
    """
    udf = F.pandas_udf(fn, "double")
    REGISTRY[name] = lambda **kw: udf(*[F.col(c) for c in input_cols])


def reward_columns(names, **params) -> dict[str, Column]:
    out = {}
    for n in names:
        out[n] = REGISTRY[n](**params.get(n, {}))
    return out
