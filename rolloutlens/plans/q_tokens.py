"""Queries: token masks, log-softmax, ratio, surrogate, KL, losses, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as TK
from ..functions.text import PY_WHITESPACE
from ..operators import token_loss as TL
from ..sources import fixtures as FX
from . import oracle as O
from .catalog import r9, register

SEQ = O.SEQUENCES
EPS_L, EPS_H = 0.2, 0.28
CLIP = f"least(greatest(r, {1 - EPS_L}), {1 + EPS_H})"


def _long(df, key, arr, out, round9=False):
    x = df.select(key, F.posexplode(arr).alias("pos", out)).withColumn("pos", F.col("pos").cast("long"))
    return x.select(key, "pos", r9(out).alias(out)) if round9 else x


def _masked(spark, sf_dir, with_old: bool = True):
    s = FX.sequences(spark, sf_dir, with_ref=with_old, with_old=with_old)
    return (s.withColumn("prefix", TK.prefix_mask(F.col("input_ids"), 4))
             .withColumn("suffix", TK.suffix_mask(F.col("input_ids"), 5))
             .withColumn("mask", TK.loss_mask(F.col("input_ids"), 4, 5)))


@register("t1_prefix_mask", f"WITH {SEQ} {O.long_form('lmask', 'seq_id', 'prefix', 'prefix')}")
def t1_prefix_mask(spark, sf_dir):
    return _long(_masked(spark, sf_dir, with_old=False), "seq_id", "prefix", "prefix")


@register("t2_suffix_mask", f"WITH {SEQ} {O.long_form('lmask', 'seq_id', 'suffix', 'suffix')}")
def t2_suffix_mask(spark, sf_dir):
    return _long(_masked(spark, sf_dir, with_old=False), "seq_id", "suffix", "suffix")


@register("t3_loss_mask", f"WITH {SEQ} {O.long_form('lmask', 'seq_id', 'mask', 'mask')}")
def t3_loss_mask(spark, sf_dir):
    return _long(_masked(spark, sf_dir, with_old=False), "seq_id", "mask", "mask")


@register("t4_log_softmax_gather", """WITH e AS (
  SELECT vec_id AS seq_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, label AS target FROM embeddings)
SELECT seq_id, round(x[target + 1] - list_max(x) - ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))), 9) + 0.0
       AS logp FROM e""")
def t4_log_softmax_gather(spark, sf_dir):
    lg = FX.logits(spark, sf_dir)
    return lg.select("seq_id", r9(TK.log_softmax_gather(F.col("logits"), F.col("target"))).alias("logp"))


@register("t4_per_token_logps", """WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x,
         list_transform(embedding[1:9], lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 50) % 64 AS INTEGER)) AS ids FROM embeddings),
p AS (SELECT vec_id, ids, pos, list_transform(list_concat(x[pos * 8 + 1:], x[1:pos * 8]), lambda v: v * (1 + pos / 8)) AS l
      FROM e, range(0, 8) AS t(pos))
SELECT vec_id AS seq_id, CAST(pos AS INTEGER) AS pos,
       """ + O.r9("l[ids[pos + 2] + 1] - list_max(l) - ln(list_sum(list_transform(l, lambda v: exp(v - list_max(l)))))") + """ AS logp FROM p""")
def t4_per_token_logps(spark, sf_dir):
    """T4 for every token of a sequence, its logits spread over rows of 24 ids."""
    d = TL.per_token_logps(FX.logit_chunks(spark, sf_dir), FX.token_sequences(spark, sf_dir))
    return d.select("seq_id", "pos", r9("logp").alias("logp"))


@register("t5_pad_truncate", f"""WITH {SEQ}, t AS (
  SELECT seq_id, list_transform(range(1, 71), lambda i: coalesce(logp[i], 0.0)) AS a,
         list_transform(range(1, 33), lambda i: coalesce(logp[i], 0.0)) AS b FROM sequences)
SELECT seq_id, unnest(range(0, 70)) AS pos, {O.r9('unnest(a)')} AS padded, {O.r9('unnest(b)')} AS cut_src
FROM (SELECT seq_id, a, list_concat(b, list_transform(range(0, 38), lambda i: NULL::DOUBLE)) AS b FROM t)""")
def t5_pad_truncate(spark, sf_dir):
    """T5 both ways: pad 63 log-probs to 70, cut them to 32 (long form)."""
    s = FX.sequences(spark, sf_dir, with_ref=False, with_old=False)
    d = s.select("seq_id", TK.pad_or_truncate(F.col("logp"), 70).alias("a"),
                 TK.pad_or_truncate(F.col("logp"), 32).alias("b"))
    x = d.select("seq_id", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "z"))
    return x.select("seq_id", F.col("pos").cast("long").alias("pos"), r9("z.a").alias("padded"), r9("z.b").alias("cut_src"))


@register("t6_importance_ratio", f"""WITH {SEQ}, t AS (
  SELECT seq_id, list_transform(logp, lambda v, i: exp(v - old_logp[i])) AS rho FROM sequences)
SELECT seq_id, unnest(range(0, len(rho))) AS pos, {O.r9('unnest(rho)')} AS rho FROM t""")
def t6_importance_ratio(spark, sf_dir):
    s = FX.sequences(spark, sf_dir, with_ref=False)
    return _long(s.select("seq_id", TK.ratio(F.col("logp"), F.col("old_logp")).alias("rho")),
                 "seq_id", "rho", "rho", round9=True)


@register("t7_clipped_surrogate", f"""WITH {SEQ}, t AS (
  SELECT seq_id, list_transform(logp, lambda v, i: exp(v - old_logp[i])) AS rho, advantage FROM sequences),
u AS (SELECT seq_id, list_transform(rho, lambda r: -least(r * advantage, {CLIP} * advantage)) AS loss FROM t)
SELECT seq_id, unnest(range(0, len(loss))) AS pos, {O.r9('unnest(loss)')} AS loss FROM u""")
def t7_clipped_surrogate(spark, sf_dir):
    s = FX.sequences(spark, sf_dir, with_ref=False)
    rho = TK.ratio(F.col("logp"), F.col("old_logp"))
    d = s.select("seq_id", TK.surrogate(rho, F.col("advantage"), EPS_L, EPS_H).alias("loss"))
    return _long(d, "seq_id", "loss", "loss", round9=True)


@register("t8_approx_kl", f"""WITH {SEQ}, t AS (
  SELECT seq_id, list_transform(logp, lambda v, i: v - ref_logp[i]) AS d FROM sequences)
SELECT seq_id, unnest(range(0, len(d))) AS pos, {O.r9('unnest(d)')} AS k1,
       {O.r9('unnest(list_transform(d, lambda x: x * x / 2.0))')} AS k2,
       {O.r9('unnest(list_transform(d, lambda x: exp(-x) - 1.0 + x))')} AS k3 FROM t""")
def t8_approx_kl(spark, sf_dir):
    s = FX.sequences(spark, sf_dir, with_old=False)
    d = s.select("seq_id", *[TK.approx_kl(F.col("logp"), F.col("ref_logp"), k).alias(k) for k in TK.KL_ESTIMATORS])
    x = d.select("seq_id", F.posexplode(F.arrays_zip("k1", "k2", "k3")).alias("pos", "z"))
    return x.select("seq_id", F.col("pos").cast("long").alias("pos"), *[r9(f"z.{k}").alias(k) for k in TK.KL_ESTIMATORS])


BETA = 0.04


def _terms_sql(beta: float, est: str = "k3") -> str:
    kl = {"k1": "d", "k2": "d * d / 2.0", "k3": "exp(-d) - 1.0 + d"}[est]
    add = f" + {beta} * (list_transform(logp, lambda v, i: v - ref_logp[i]))[i]" if beta > 0 else ""
    return f"""{SEQ},
t AS (SELECT seq_id, advantage, mask, logp, ref_logp,
             list_transform(logp, lambda v, i: exp(v - old_logp[i])) AS rho FROM lmask),
kl AS (SELECT *, list_transform(list_transform(logp, lambda v, i: v - ref_logp[i]), lambda d: {kl}) AS klv FROM t),
lo AS (SELECT *, list_transform(rho, lambda r, i: -least(r * advantage, {CLIP} * advantage){" + " + str(beta) + " * klv[i]" if beta > 0 else ""}) AS loss,
              list_transform(rho, lambda r: CASE WHEN r * advantage < {CLIP} * advantage THEN 1.0 ELSE 0.0 END) AS clipped,
              list_transform(rho, lambda r: CASE WHEN {CLIP} * advantage < r * advantage THEN 1.0 ELSE 0.0 END) AS active
       FROM kl),
terms AS (
  SELECT seq_id, CAST(floor(seq_id / 4) AS BIGINT) AS batch,
         coalesce(list_sum(mask), 0) AS s_mask,
         coalesce(list_sum(list_transform(loss, lambda v, i: coalesce(v * mask[i], 0.0))), 0.0) AS s_loss,
         coalesce(list_sum(list_transform(clipped, lambda v, i: coalesce(v * mask[i], 0.0))), 0.0) AS s_clip,
         coalesce(list_sum(list_transform(active, lambda v, i: coalesce(v * mask[i], 0.0))), 0.0) AS s_active,
         coalesce(list_sum(list_transform(klv, lambda v, i: coalesce(v * mask[i], 0.0))), 0.0) AS s_kl
  FROM lo)"""


@register("t9_kl_penalty", f"""WITH {_terms_sql(BETA)}
SELECT seq_id, unnest(range(0, len(loss))) AS pos, {O.r9('unnest(loss)')} AS loss FROM lo""")
def t9_kl_penalty(spark, sf_dir):
    s = FX.sequences(spark, sf_dir)
    rho = TK.ratio(F.col("logp"), F.col("old_logp"))
    loss = TK.add_scaled(TK.surrogate(rho, F.col("advantage"), EPS_L, EPS_H),
                         TK.approx_kl(F.col("logp"), F.col("ref_logp"), "k3"), BETA)
    return _long(s.select("seq_id", loss.alias("loss")), "seq_id", "loss", "loss", round9=True)


def _batch(spark, sf_dir, beta):
    """T9's plan-time branch: with beta = 0 the reference log-probs are never
    joined or read."""
    t = TL.sequence_terms(FX.sequences(spark, sf_dir, with_ref=beta > 0), beta=beta, eps_low=EPS_L,
                          eps_high=EPS_H, kl_estimator="k3")
    return TL.batch_metrics(t, 4, with_kl=beta > 0)


@register("t10_sequence_loss", f"""WITH {_terms_sql(0.0)}
SELECT batch, {O.r9('avg(CASE WHEN s_mask > 0 THEN s_loss / s_mask END)')} AS loss,
       CAST(sum(CASE WHEN s_mask = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_empty, count(*) AS n_seqs
FROM terms GROUP BY batch""")
def t10_sequence_loss(spark, sf_dir):
    b = _batch(spark, sf_dir, 0.0)
    return b.select("batch", r9("loss").alias("loss"), F.col("n_empty").cast("long").alias("n_empty"), "n_seqs")


@register("t11_mean_kl", f"""WITH {_terms_sql(BETA)}
SELECT batch, {O.r9('avg(s_kl / (s_mask + 0.0001))')} AS kl,
       {O.r9('avg(CASE WHEN s_mask > 0 THEN s_loss / s_mask END)')} AS loss FROM terms GROUP BY batch""")
def t11_mean_kl(spark, sf_dir):
    b = _batch(spark, sf_dir, BETA)
    return b.select("batch", r9("kl").alias("kl"), r9("loss").alias("loss"))


@register("t12_clip_ratio", f"""WITH {_terms_sql(0.0)}
SELECT batch, {O.r9('CASE WHEN sum(s_mask) > 0 THEN sum(s_clip) / sum(s_mask) END')} AS clip_ratio,
       {O.r9('CASE WHEN sum(s_mask) > 0 THEN sum(s_active) / sum(s_mask) END')} AS clip_active_ratio
FROM terms GROUP BY batch""")
def t12_clip_ratio(spark, sf_dir):
    """T12 (the reference's indicator) and the clip-active ratio (Q4)."""
    b = _batch(spark, sf_dir, 0.0)
    return b.select("batch", r9("clip_ratio").alias("clip_ratio"), r9("clip_active_ratio").alias("clip_active_ratio"))


@register("g7_completion_length", f"""WITH {_terms_sql(0.0)}
SELECT batch, {O.r9('avg(s_mask)')} AS completion_length FROM terms GROUP BY batch""")
def g7_completion_length(spark, sf_dir):
    b = _batch(spark, sf_dir, 0.0)
    return b.select("batch", r9("completion_length").alias("completion_length"))


@register("t13_token_surprise", f"""WITH {SEQ}, t AS (
  SELECT seq_id, list_transform(logp, lambda v, i: (1.0 - exp(v)) * mask[i]) AS s FROM lmask)
SELECT seq_id, unnest(range(0, len(s))) AS pos, {O.r9('unnest(s)')} AS surprise FROM t""")
def t13_token_surprise(spark, sf_dir):
    d = _masked(spark, sf_dir, with_old=False).select("seq_id", TK.surprise(F.col("logp"), F.col("mask")).alias("s"))
    return _long(d, "seq_id", "s", "surprise", round9=True)


@register("t14_align_tokens", f"""WITH {SEQ}, t AS (
  SELECT seq_id, list_transform(input_ids, lambda x: CASE WHEN x = 0 THEN '[SEP]' WHEN x % 2 = 0 THEN chr(10) || chr(9) || ' tok' || CAST(x AS VARCHAR) ELSE ' tok' || CAST(x AS VARCHAR) END) AS toks,
         list_transform(logp, lambda v, i: (1.0 - exp(v)) * mask[i]) AS s FROM lmask),
z AS (SELECT seq_id, unnest(range(0, len(s))) AS pos, unnest(toks[2:len(s) + 1]) AS token, unnest(s) AS score FROM t)
SELECT seq_id, pos, regexp_replace(token, {O.lit('^' + O.PY_WHITESPACE)}, '') AS token, {O.r9('score')} AS score FROM z WHERE token <> '[SEP]'""")
def t14_align_tokens(spark, sf_dir):
    """Drop the first token, pair tokens with surprise scores, left-strip
    token text, skip separator tokens (token text derived from the ids)."""
    d = _masked(spark, sf_dir, with_old=False)
    toks = F.transform("input_ids", lambda x: F.when(x == 0, F.lit("[SEP]"))
                       .when(x % 2 == 0, F.concat(F.lit("\n\t tok"), x.cast("string"))).otherwise(F.concat(F.lit(" tok"), x.cast("string"))))
    s = TK.surprise(F.col("logp"), F.col("mask"))
    d = d.select("seq_id", F.slice(toks, 2, F.size("logp")).alias("t"), s.alias("s"))
    x = d.select("seq_id", F.posexplode(F.arrays_zip("t", "s")).alias("pos", "z"))
    x = x.filter(F.col("z.t") != "[SEP]")
    return x.select("seq_id", F.col("pos").cast("long").alias("pos"), F.regexp_replace(F.col("z.t"), "^" + PY_WHITESPACE, "").alias("token"), r9("z.s").alias("score"))


@register("j6_logprob_join", f"""WITH {SEQ}
SELECT seq_id, unnest(range(0, len(logp))) AS pos, {O.r9('unnest(logp)')} AS logp,
       {O.r9('unnest(old_logp)')} AS old_logp, {O.r9('unnest(ref_logp)')} AS ref_logp FROM sequences""")
def j6_logprob_join(spark, sf_dir):
    """New / old / reference log-probs of the same tokens, joined on
    seq_id (inside the fixture) and zipped position by position."""
    s = FX.sequences(spark, sf_dir)
    x = s.select("seq_id", F.posexplode(F.arrays_zip("logp", "old_logp", "ref_logp")).alias("pos", "z"))
    return x.select("seq_id", F.col("pos").cast("long").alias("pos"), *[r9(f"z.{c}").alias(c) for c in ("logp", "old_logp", "ref_logp")])


@register("s9_metrics_interval", f"""SELECT event_type AS run, CAST(floor(event_id / 16) AS BIGINT) AS log_step,
       CASE event_id % 3 WHEN 0 THEN 'completion_length' WHEN 1 THEN 'kl' ELSE 'clip_ratio' END AS metric,
       {O.r9('avg(value)')} AS value, count(*) AS n
FROM events GROUP BY ALL""")
def s9_metrics_interval(spark, sf_dir):
    """Training metrics averaged per log interval."""
    m = TL.interval_metrics(FX.train_metrics(spark, sf_dir))
    return m.select("run", "log_step", "metric", r9("value").alias("value"), "n")


@register("s9_training_metrics_sink", f"""WITH {_terms_sql(BETA)},
b AS (SELECT batch, avg(CASE WHEN s_mask > 0 THEN s_loss / s_mask END) AS loss, avg(s_mask) AS completion_length,
             avg(s_kl / (s_mask + 0.0001)) AS kl, CASE WHEN sum(s_mask) > 0 THEN sum(s_clip) / sum(s_mask) END AS clip_ratio
      FROM terms GROUP BY batch),
m AS (SELECT batch // 4 AS step, unnest(['loss', 'completion_length', 'kl', 'clip_ratio']) AS metric,
             unnest([loss, completion_length, kl, clip_ratio]) AS value FROM b)
SELECT 'train' AS phase, step, metric, {O.r9('avg(value)')} AS value FROM m GROUP BY step, metric""")
def s9_training_metrics_sink(spark, sf_dir):
    """Entry 3 end to end: sequences -> J6 -> T1-T12, G7 per batch -> averages
    per logging interval (4 batches) -> appended to the metrics table (S9) and
    read back."""
    from ..session import scratch_path
    from ..sources import sinks as SK
    b = _batch(spark, sf_dir, BETA)
    names = ("loss", "completion_length", "kl", "clip_ratio")
    step = b.groupBy(F.expr("batch div 4").alias("step")).agg(*[F.avg(n).alias(n) for n in names])
    rows = SK.metrics_long(step.select(F.lit("run").alias("run"), F.lit("train").alias("phase"), "step", *names), names)
    path = scratch_path(spark, "train-metrics")
    SK.append_metrics(rows, path, batch=0)
    return spark.read.parquet(path).select("phase", "step", "metric", r9("value").alias("value"))
