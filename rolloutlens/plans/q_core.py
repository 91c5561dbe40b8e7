"""Queries: answers, rewards on the rollout table, groups, advantages, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import groups as G
from ..operators import rewards as R
from ..sources import fixtures as FX
from . import oracle as O
from . import scoring as S
from .catalog import doc_scored, event_scored, event_table, r9, register

K = "prompt_idx, gen_idx"
DOCS = O.scored_ctes(O.ROLLOUTS)
EVENTS = O.scored_ctes(O.ROLLOUTS_EVENTS)


# -- P7, A1-A4, A13 ------------------------------------------------------------

@register("p7_last_message", f"""
SELECT conv_id, arg_max(text, turn) AS last_content FROM conversations GROUP BY conv_id""")
def p7_last_message(spark, sf_dir):
    """P7 on ``conversations``: the last message of every conversation
    (``max_by`` is a partial aggregate: no whole conversation in one task)."""
    c = FX.read_table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_content"))


@register("a1_extract_answer", f"""WITH {DOCS}
SELECT {K}, ans_canon, gold_canon FROM scored""")
def a1_extract_answer(spark, sf_dir):
    d = doc_scored(spark, sf_dir)
    return d.select("prompt_idx", "gen_idx", F.col("ans.canon").alias("ans_canon"),
                    F.col("gold_ans.canon").alias("gold_canon"))


@register("a2_answer_equal", f"""WITH {DOCS}
SELECT {K}, CAST({O.equal("ans", "gold")} AS INTEGER) AS equal,
       CAST(ans_num IS NOT NULL AS INTEGER) AS numeric FROM scored""")
def a2_answer_equal(spark, sf_dir):
    from ..functions.answers import answers_equal
    d = doc_scored(spark, sf_dir)
    return d.select("prompt_idx", "gen_idx",
                    answers_equal(F.col("ans"), F.col("gold_ans")).cast("int").alias("equal"),
                    F.col("ans.num").isNotNull().cast("int").alias("numeric"))


@register("a2_wide_numbers", f"""WITH {O.scored_ctes(O.WIDE_ANSWERS)}
SELECT prompt_idx, ans_canon, gold_canon, CAST({O.equal("ans", "gold")} AS INTEGER) AS equal,
       CAST(ans_num IS NOT NULL AS INTEGER) AS numeric FROM scored""")
def a2_wide_numbers(spark, sf_dir):
    """A2 on numbers of 19 digits: whole, decimal, with thousands commas, as
    fractions of either kind with signs, equal or apart by one."""
    from ..functions.answers import answers_equal
    d = S.score(FX.wide_answers(spark, sf_dir))
    return d.select("prompt_idx", F.col("ans.canon").alias("ans_canon"), F.col("gold_ans.canon").alias("gold_canon"),
                    answers_equal(F.col("ans"), F.col("gold_ans")).cast("int").alias("equal"),
                    F.col("ans.num").isNotNull().cast("int").alias("numeric"))


@register("a2_nested_values", """WITH v AS (
  SELECT o_orderkey AS k, o_orderkey % 5 AS a, o_custkey % 7 AS b, CAST(floor(o_totalprice) AS BIGINT) % 3 AS c FROM orders)
SELECT k AS prompt_idx, CAST(CASE k % 4 WHEN 0 THEN a = b AND b = c AND k % 7 <> 0 WHEN 3 THEN k % 7 <> 0 AND k % 3 <> 0
                             ELSE k % 7 <> 0 END AS INTEGER) AS equal FROM v""")
def a2_nested_values(spark, sf_dir):
    """A1 / A2 on tuples, sets, sets of pairs and intervals. The SQL compares the
    values that the pairs were spelled from, not their texts: a tuple turned by
    one place is equal if all three are, a set in another order is equal."""
    from ..functions.answers import answers_equal
    d = S.score(FX.nested_answers(spark, sf_dir))
    return d.select("prompt_idx", answers_equal(F.col("ans"), F.col("gold_ans")).cast("int").alias("equal"))


@register("a3_accuracy_reward", f"""WITH {DOCS}
SELECT {K}, acc FROM scored""")
def a3_accuracy_reward(spark, sf_dir):
    return doc_scored(spark, sf_dir).select("prompt_idx", "gen_idx", "acc")


@register("a4_format_reward", f"""WITH {DOCS}
SELECT {K}, fmt FROM scored""")
def a4_format_reward(spark, sf_dir):
    return FX.rollouts(spark, sf_dir).select("prompt_idx", "gen_idx", R.format_reward().alias("fmt"))


@register("a13_weighted_reward", f"""WITH {DOCS}
SELECT {K}, acc, fmt, reward FROM scored""")
def a13_weighted_reward(spark, sf_dir):
    return doc_scored(spark, sf_dir).select("prompt_idx", "gen_idx", "acc", "fmt", "reward")


# -- A5, A6, A8, A9, A10, A12 (row rewards on the document rollouts) -----------------

def _tag_sql(tag: str) -> str:
    t = O.lit(tag)
    return (f"(CASE WHEN (length(content) - length(replace(content, {t}, ''))) / length({t}) = 1 "
            f"THEN 0.25 ELSE 0.0 END)")


@register("a5_tag_count_reward", f"""WITH {O.ROLLOUTS}
SELECT {K}, CAST({' + '.join(_tag_sql(t) for t in TX.TAGS)} AS DOUBLE) AS tag_count FROM rollouts""")
def a5_tag_count_reward(spark, sf_dir):
    return FX.rollouts(spark, sf_dir).select(
        "prompt_idx", "gen_idx", TX.tag_count_reward(F.col("content")).alias("tag_count"))


@register("a6_reasoning_steps_reward", f"""WITH {O.ROLLOUTS}
SELECT {K}, {O.r9(f"least(1.0, len(regexp_extract_all(content, {O.lit(O.STEPS)})) / 3.0)")} AS steps
FROM rollouts""")
def a6_reasoning_steps_reward(spark, sf_dir):
    return FX.rollouts(spark, sf_dir).select(
        "prompt_idx", "gen_idx", r9(TX.reasoning_steps_reward(F.col("content"))).alias("steps"))


@register("a8_cosine_reward", f"""WITH {DOCS}
SELECT {K}, {O.r9('''CASE WHEN gold_canon IS NULL THEN 1.0 ELSE
  lo + 0.5 * (hi - lo) * (1.0 + cos(CAST(length(content) AS DOUBLE) / 1000.0 * pi())) END''')} AS cosine
FROM (SELECT *, CASE WHEN correct THEN 0.5 ELSE -0.5 END AS lo,
                CASE WHEN correct THEN 1.0 ELSE -1.0 END AS hi FROM scored)""")
def a8_cosine_reward(spark, sf_dir):
    d = doc_scored(spark, sf_dir)
    return d.select("prompt_idx", "gen_idx", r9(R.cosine_reward()).alias("cosine"))


def _rep_sql(n: int, penalty: float) -> str:
    ws = O.lit(O.PY_WHITESPACE)
    words = f"list_filter(regexp_split_to_array(lower(content), {ws}), lambda w: w <> '')"
    return f"""SELECT {K}, {O.r9(f'''CASE WHEN content = '' OR len(w) < {n} THEN 0.0
  ELSE (1.0 - len(list_distinct(grams)) / (len(w) - {n - 1})) * ({penalty}) END''')} AS repetition
FROM (SELECT *, list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1),
                               lambda i: array_to_string(w[i:i + {n - 1}], ' ')) AS grams
      FROM (SELECT *, {words} AS w FROM rollouts))"""


@register("a9_repetition_penalty", f"WITH {O.ROLLOUTS} {_rep_sql(3, -1.0)}")
def a9_repetition_penalty(spark, sf_dir):
    d = FX.rollouts(spark, sf_dir)
    return d.select("prompt_idx", "gen_idx", r9(R.repetition_reward()).alias("repetition"))


@register("a9_repetition_documents", f"""WITH rollouts AS (
  SELECT doc_id AS prompt_idx, 0 AS gen_idx, text AS content FROM documents)
{_rep_sql(3, -1.0)}""")
def a9_repetition_documents(spark, sf_dir):
    """A9 over whole documents (up to 20,000 words each)."""
    d = FX.read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("prompt_idx"), F.lit(0).alias("gen_idx"),
                    r9(TX.repetition_penalty(F.col("text"), 3, -1.0)).alias("repetition"))


@register("a10_extract_code", f"""WITH {O.ROLLOUTS}
SELECT {K}, coalesce(regexp_extract_all(content, {O.lit(O.CODE_BLOCK)}, 1)[-1], '') AS code
FROM rollouts""")
def a10_extract_code(spark, sf_dir):
    d = FX.rollouts(spark, sf_dir)
    return d.select("prompt_idx", "gen_idx", TX.extract_code(F.col("content")).alias("code"))


@register("a12_code_format_reward", f"""WITH {O.ROLLOUTS}
SELECT {K}, CAST(CASE WHEN regexp_matches(content, {O.lit(O.CODE_FORMAT)}) THEN 1 ELSE 0 END AS DOUBLE)
       AS code_format FROM rollouts""")
def a12_code_format_reward(spark, sf_dir):
    d = FX.rollouts(spark, sf_dir)
    return d.select("prompt_idx", "gen_idx",
                    TX.code_format_reward(F.col("content"), "python").alias("code_format"))


# -- A7 length reward in group ------------------------------------------------

@register("a7_length_reward", f"""WITH {DOCS}
SELECT {K}, {O.r9('''CASE WHEN mx = mn THEN 0.0
  WHEN correct THEN 0.5 - (len - mn) / (mx - mn)
  ELSE least(0.0, 0.5 - (len - mn) / (mx - mn)) END''')} AS len_reward
FROM (SELECT *, CAST(length(content) AS DOUBLE) AS len,
             min(length(content)) OVER (PARTITION BY prompt_idx) AS mn,
             max(length(content)) OVER (PARTITION BY prompt_idx) AS mx FROM scored)""")
def a7_length_reward(spark, sf_dir):
    d = R.length_reward(doc_scored(spark, sf_dir))
    return d.select("prompt_idx", "gen_idx", r9("len_reward").alias("len_reward"))


@register("a13_weighted_with_length", f"""WITH {DOCS}
SELECT {K}, {O.r9("""reward + 0.5 * (CASE WHEN mx = mn THEN 0.0
  WHEN correct THEN 0.5 - (len - mn) / (mx - mn)
  ELSE least(0.0, 0.5 - (len - mn) / (mx - mn)) END)""")} AS reward
FROM (SELECT *, CAST(length(content) AS DOUBLE) AS len,
             min(length(content)) OVER (PARTITION BY prompt_idx) AS mn,
             max(length(content)) OVER (PARTITION BY prompt_idx) AS mx FROM scored)""")
def a13_weighted_with_length(spark, sf_dir):
    """A13 over accuracy, format and the group-aware length reward."""
    d = doc_scored(spark, sf_dir, weights={"accuracy": 1.0, "format": 1.0, "length": 0.5})
    return d.select("prompt_idx", "gen_idx", r9("reward").alias("reward"))


# -- groups: G1, G3, W1, F1, F2 (events rollouts: 8 per prompt) ----------------

@register("g1_group_accuracy", f"""WITH {EVENTS}
SELECT prompt_idx, {O.r9('avg(acc)')} AS acc_mean FROM scored GROUP BY prompt_idx""")
def g1_group_accuracy(spark, sf_dir):
    st = G.group_stats(event_scored(spark, sf_dir))
    return st.select("prompt_idx", r9("acc_mean").alias("acc_mean"))


@register("g3_group_mean_std", f"""WITH {EVENTS}
SELECT prompt_idx, {O.r9('avg(reward)')} AS mean, {O.r9('stddev_pop(reward)')} AS std,
       count(*) AS n FROM scored GROUP BY prompt_idx""")
def g3_group_mean_std(spark, sf_dir):
    st = G.group_stats(event_scored(spark, sf_dir), acc=None)
    return st.select("prompt_idx", r9("mean").alias("mean"), r9("std").alias("std"), "n")


ADV_SQL = f"""adv AS (
  SELECT *, (reward - mean) / (std + 0.0001) AS advantage
  FROM (SELECT *, avg(reward) OVER (PARTITION BY prompt_idx) AS mean,
               stddev_pop(reward) OVER (PARTITION BY prompt_idx) AS std FROM scored))"""


@register("w1_group_advantage", f"""WITH {EVENTS}, {ADV_SQL}
SELECT {K}, reward, {O.r9('advantage')} AS advantage FROM adv""")
def w1_group_advantage(spark, sf_dir):
    d = G.with_advantages(event_table(spark, sf_dir))
    return d.select("prompt_idx", "gen_idx", "reward", r9("advantage").alias("advantage"))


@register("f1_drop_flat_groups", f"""WITH {EVENTS}, {ADV_SQL}
SELECT {K}, reward, {O.r9('std')} AS std FROM adv WHERE std >= 0.1""")
def f1_drop_flat_groups(spark, sf_dir):
    d = G.drop_flat_groups(G.with_advantages(event_table(spark, sf_dir)))
    return d.select("prompt_idx", "gen_idx", "reward", r9("std").alias("std"))


@register("f2_positive_advantage", f"""WITH {EVENTS}, {ADV_SQL}
SELECT {K}, {O.r9('advantage')} AS advantage, reward, gold AS label
FROM adv WHERE std >= 0.1 AND advantage > 0""")
def f2_positive_advantage(spark, sf_dir):
    """W1 + F1 + F2: the buffer rows of one collection pass."""
    d = S.buffer_rows(event_table(spark, sf_dir))
    return d.select("prompt_idx", "gen_idx", r9("advantage").alias("advantage"), "reward",
                    F.col("gold").alias("label"))
