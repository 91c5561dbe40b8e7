"""Prompt side: questions, gold labels, group expansion, message lists
(P1-P6, P9) and the prompt <-> completion join (J1),
by keys or by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as TX

BS = "\\"


def question(adapter: str, mode: str = "train") -> Column:
    """The question text per adapter and mode (test mode reads ``problem``)."""
    if mode == "test" or adapter == "test":
        return F.col("problem")
    if adapter == "dapo":
        return TX.clean_dapo_question(F.get(F.col("prompt"), F.lit(0))["content"])
    if adapter == "xr1":
        return F.col("problem")
    if adapter == "aime":
        return F.col("question")
    raise ValueError(f"unknown adapter {adapter!r}")


def gold_label(adapter: str, mode: str = "train") -> Column:
    """P5: ``\\boxed{answer}``, or the raw solution for the X-R1 form."""
    def boxed(c):
        return F.concat(F.lit(BS + "boxed{"), c.cast("string"), F.lit("}"))
    if mode == "test" or adapter == "test":
        return boxed(F.col("answer"))
    if adapter == "dapo":
        return boxed(F.col("reward_model.ground_truth"))
    if adapter == "xr1":
        return F.col("solution")
    if adapter == "aime":
        return boxed(F.col("answer"))
    raise ValueError(f"unknown adapter {adapter!r}")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def expand_group(df: DataFrame, group_size: int = C.GROUP_SIZE, system_prompts=None) -> DataFrame:
    """One row per system text (``gen_idx`` 0..G-1); the texts may differ."""
    sys_sets = list(system_prompts) if system_prompts else [C.SYSTEM_PROMPT] * group_size
    return df.select("*", F.posexplode(F.array(*[F.lit(s) for s in sys_sets])).alias("gen_idx", "sys_text"))


def two_message_prompt(sys_text: Column, user_text: Column) -> Column:
    """[system, user] message list."""
    return F.array(message("system", sys_text), message("user", user_text))


def append_turn(messages: Column, content: Column, role: str = "assistant") -> Column:
    """Message list + one more turn."""
    return F.concat(messages, F.array(message(role, content)))


def build_prompts(problems: DataFrame, adapter: str, mode: str = "train",
                  group_size: int = C.GROUP_SIZE, key: str = "row_id", system_prompts=None) -> DataFrame:
    """(prompt_idx, gen_idx, messages, gold) - G prompts per problem."""
    d = problems.select(F.col(key).alias("prompt_idx"), question(adapter, mode).alias("_q"),
                        gold_label(adapter, mode).alias("gold"))
    d = expand_group(d, group_size, system_prompts)
    return d.select("prompt_idx", F.col("gen_idx").cast("int").alias("gen_idx"),
                    two_message_prompt(F.col("sys_text"), F.col("_q")).alias("messages"), "gold")


def attach_completions(prompts: DataFrame, completions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J1 + P6: prompts joined with generated outputs on (prompt_idx,
    gen_idx), the assistant turn appended; plus a report of prompts that got
    no completion and completions without a prompt (anti joins)."""
    keys = ["prompt_idx", "gen_idx"]
    joined = (prompts.join(completions, keys, "inner")
                     .withColumn("messages", append_turn(F.col("messages"), F.col("content"))))
    no_completion = prompts.join(completions, keys, "left_anti").select(*keys, F.lit("no_completion").alias("issue"))
    no_prompt = completions.join(prompts, keys, "left_anti").select(*keys, F.lit("no_prompt").alias("issue"))
    return joined, no_completion.unionByName(no_prompt)


def pair_by_position(left: DataFrame, right: DataFrame, position: str = "row_pos") -> DataFrame:
    """J1 / J3 without keys: the rows of two tables at the same place, as a zip
    of two lists does; places beyond the shorter table have no pair. Both carry
    their dense ``position`` (:func:`rolloutlens.sources.readers.read_positioned`).
    Places are unique, so the join has no hot key. Other columns of the same
    name would be ambiguous, so they raise."""
    clash = (set(map(str.lower, left.columns)) & set(map(str.lower, right.columns))) - {position.lower()}
    if clash:
        raise ValueError(f"both tables have the columns {sorted(clash)}")
    return left.join(right, position)


def exploded_cases(problems: DataFrame, key: str = "prompt_idx") -> DataFrame:
    """One row per test case of a problem's ``test_cases`` array
    (case_id counts from 0; input and expected come from the struct)."""
    x = problems.select(key, F.posexplode("test_cases").alias("case_id", "_case"))
    return x.select(key, "case_id", F.col("_case.input").alias("input"), F.col("_case.expected").alias("expected"))
