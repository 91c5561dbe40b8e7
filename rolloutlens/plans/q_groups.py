"""Queries: majority vote, neighbour comparison, gold handling, run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups as G
from ..sources import fixtures as FX
from . import oracle as O
from . import scoring as S
from .catalog import event_scored, event_table, r9, register

EVENTS = O.scored_ctes(O.ROLLOUTS_EVENTS)
NOGOLD = O.scored_ctes(O.ROLLOUTS_EVENTS + """,
rl AS (SELECT prompt_idx, gen_idx, CASE WHEN prompt_idx % 5 = 0 THEN 'no label' ELSE gold END AS gold,
              content FROM rollouts)""", src="rl")

W = "OVER (PARTITION BY prompt_idx ORDER BY gen_idx)"


def majority_sql(scored: str = "scored") -> str:
    """CTEs prev -> starts -> runs -> best -> maj(prompt_idx, majority)."""
    return f"""prev AS (
  SELECT *, lag(gen_idx) {W} AS p_gen, lag(ans_canon) {W} AS p_canon,
         lag(ans_num) {W} AS p_num, lag(ans_den) {W} AS p_den FROM {scored}),
starts AS (
  SELECT *, CASE WHEN ans_canon IS NOT NULL
                  AND NOT coalesce(p_gen = gen_idx - 1 AND {O.equal("ans", "p")}, false)
                 THEN gen_idx END AS st FROM prev),
runs0 AS (
  SELECT *, max(st) OVER (PARTITION BY prompt_idx ORDER BY gen_idx
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM starts),
runs AS (
  SELECT prompt_idx, run, count(*) AS n, arg_min(acc, gen_idx) AS v0
  FROM runs0 WHERE ans_canon IS NOT NULL GROUP BY prompt_idx, run),
best AS (
  SELECT prompt_idx, v0 FROM (
    SELECT *, row_number() OVER (PARTITION BY prompt_idx ORDER BY n DESC, run) AS rk FROM runs)
  WHERE rk = 1),
gflag AS (SELECT prompt_idx, bool_or(gold_canon IS NULL) AS gu FROM {scored} GROUP BY prompt_idx),
maj AS (
  SELECT prompt_idx, CASE WHEN gu THEN 1.0 ELSE coalesce(v0, 0.0) END AS majority
  FROM gflag LEFT JOIN best USING (prompt_idx))"""


@register("g2_majority_vote", f"""WITH {EVENTS}, {majority_sql()}
SELECT prompt_idx, CAST(majority AS DOUBLE) AS majority FROM maj""")
def g2_majority_vote(spark, sf_dir):
    return G.majority_run(event_table(spark, sf_dir))


@register("g2_majority_vote_documents", f"""WITH {O.scored_ctes(O.ROLLOUTS)}, {majority_sql()}
SELECT prompt_idx, CAST(majority AS DOUBLE) AS majority FROM maj""")
def g2_majority_vote_documents(spark, sf_dir):
    from .catalog import doc_scored
    return G.majority_run(S.scored_table(doc_scored(spark, sf_dir)))


@register("w2_compare_previous", f"""WITH {EVENTS}, {majority_sql()}
SELECT prompt_idx, gen_idx,
       CAST(coalesce(p_gen = gen_idx - 1 AND {O.equal("ans", "p")}, false) AS INTEGER) AS connect
FROM prev""")
def w2_compare_previous(spark, sf_dir):
    d = G.with_connect(event_scored(spark, sf_dir))
    return d.select("prompt_idx", "gen_idx", F.col("connect").cast("int").alias("connect"))


def _nogold(spark, sf_dir):
    r = FX.rollouts_events(spark, sf_dir)
    r = r.withColumn("gold", F.when(F.col("prompt_idx") % 5 == 0, F.lit("no label")).otherwise(F.col("gold")))
    return S.scored_table(S.score(r))


@register("f3_unparseable_gold", f"""WITH {NOGOLD}, {majority_sql()}
SELECT prompt_idx, {O.r9("avg(acc)")} AS acc_mean, CAST(any_value(majority) AS DOUBLE) AS majority
FROM scored JOIN maj USING (prompt_idx) GROUP BY prompt_idx""")
def f3_unparseable_gold(spark, sf_dir):
    sc = _nogold(spark, sf_dir)
    st = G.group_stats(sc)
    return (st.join(G.majority_run(sc), "prompt_idx")
              .select("prompt_idx", r9("acc_mean").alias("acc_mean"), "majority"))


@register("f4_parseable_answers", f"""WITH {EVENTS}
SELECT prompt_idx, count(*) AS n_parsed FROM scored WHERE ans_canon IS NOT NULL GROUP BY prompt_idx""")
def f4_parseable_answers(spark, sf_dir):
    sc = event_scored(spark, sf_dir)
    return sc.filter(F.col("ans.canon").isNotNull()).groupBy("prompt_idx").agg(
        F.count(F.lit(1)).alias("n_parsed"))


@register("p10_group_length", f"""WITH {EVENTS}
SELECT prompt_idx, {O.r9("avg(length(content))")} AS mean_length FROM scored GROUP BY prompt_idx""")
def p10_group_length(spark, sf_dir):
    sc = event_scored(spark, sf_dir).withColumn("_len", F.length("content"))
    st = G.group_stats(sc, acc=None, length="_len")
    return st.select("prompt_idx", r9("mean_length").alias("mean_length"))


@register("p10_group_length_words", f"""WITH {O.ROLLOUTS}
SELECT prompt_idx, {O.r9("avg(len(list_filter(regexp_split_to_array(lower(content), " + O.lit(O.PY_WHITESPACE) + "), lambda w: w <> '')))")}
       AS mean_words FROM rollouts GROUP BY prompt_idx""")
def p10_group_length_words(spark, sf_dir):
    """P10 with the pluggable length set to whitespace words."""
    from ..functions.text import length_column
    r = FX.rollouts(spark, sf_dir).withColumn("_len", length_column(F.col("content"), "words"))
    st = G.group_stats(r.withColumn("reward", F.lit(0.0)), acc=None, length="_len")
    return st.select("prompt_idx", r9("mean_length").alias("mean_words"))


@register("g4_run_metrics", f"""WITH {EVENTS}, {majority_sql()},
gs AS (SELECT prompt_idx, avg(acc) AS acc_mean, avg(length(content)) AS mean_length
       FROM scored GROUP BY prompt_idx)
SELECT {O.r9("avg(acc_mean)")} AS acc_ave, {O.r9("avg(majority)")} AS acc_major,
       {O.r9("avg(mean_length)")} AS length, count(*) AS n_groups,
       (SELECT {O.r9("avg(reward)")} FROM scored) AS reward, (SELECT count(*) FROM scored) AS n_rows
FROM gs JOIN maj USING (prompt_idx)""")
def g4_run_metrics(spark, sf_dir):
    sc = event_table(spark, sf_dir)
    rep = S.group_report(sc)
    m = G.run_metrics(sc, rep)
    return m.select(r9("acc_ave").alias("acc_ave"), r9("acc_major").alias("acc_major"),
                    r9("length").alias("length"), "n_groups", r9("reward").alias("reward"), "n_rows")


@register("j2_gold_join", f"""WITH {O.ROLLOUTS_EVENTS},
comp AS (SELECT prompt_idx, gen_idx, content FROM rollouts),
prob AS (SELECT prompt_idx, gold FROM rollouts WHERE gen_idx = 0),
p1 AS (SELECT c.*, p.gold, {O.parsed_cols("c.content", "ans")}, {O.parsed_cols("p.gold", "gold", gold=True)}
       FROM comp c JOIN prob p USING (prompt_idx)),
parsed AS (SELECT *, {O.numeric_cols("ans")}, {O.numeric_cols("gold")} FROM p1)
SELECT prompt_idx, gen_idx, CAST(gold_canon IS NULL OR {O.equal("ans", "gold")} AS DOUBLE) AS acc FROM parsed""")
def j2_gold_join(spark, sf_dir):
    r = FX.rollouts_events(spark, sf_dir)
    comp = r.select("prompt_idx", "gen_idx", "content")
    prob = r.filter(F.col("gen_idx") == 0).select("prompt_idx", "gold")
    return S.score_with_gold_table(comp, prob).select("prompt_idx", "gen_idx", "acc")
