"""Queries: cumulative sums, z-scores, masked statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalize as N
from ..sources import fixtures as FX
from . import oracle as O
from .catalog import r9, register
from .q_tokens import _masked

TOK = f"""{O.SEQUENCES},
tok AS (SELECT seq_id, unnest(range(0, len(logp))) AS pos, unnest(logp) AS value, unnest(mask) AS m FROM lmask)"""


def tokens_long(spark, sf_dir):
    d = _masked(spark, sf_dir, with_old=False)
    x = d.select("seq_id", F.posexplode(F.arrays_zip("logp", "mask")).alias("pos", "z"))
    return x.select("seq_id", F.col("pos").cast("long").alias("pos"), F.col("z.logp").alias("value"),
                    F.col("z.mask").alias("m"))


@register("w4_cumsum_forward", f"""WITH {TOK}
SELECT seq_id, pos, {O.r9('sum(value) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)')} AS cumsum
FROM tok""")
def w4_cumsum_forward(spark, sf_dir):
    d = N.cumulative_sum(tokens_long(spark, sf_dir), "seq_id", "pos", "value")
    return d.select("seq_id", "pos", r9("cumsum").alias("cumsum"))


@register("w4_cumsum_reverse", f"""WITH {TOK}
SELECT seq_id, pos, {O.r9('sum(value) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')}
       AS cumsum FROM tok""")
def w4_cumsum_reverse(spark, sf_dir):
    d = N.cumulative_sum(tokens_long(spark, sf_dir), "seq_id", "pos", "value", reverse=True)
    return d.select("seq_id", "pos", r9("cumsum").alias("cumsum"))


@register("w4_cumsum_dim0", f"""WITH {TOK}
SELECT seq_id, pos, {O.r9('sum(value) OVER (PARTITION BY pos ORDER BY seq_id ROWS UNBOUNDED PRECEDING)')} AS cumsum
FROM tok""")
def w4_cumsum_dim0(spark, sf_dir):
    """W4 along dim 0: across sequences at each position."""
    d = N.cumulative_sum(tokens_long(spark, sf_dir), "pos", "seq_id", "value", dense=False)
    return d.select("seq_id", "pos", r9("cumsum").alias("cumsum"))


@register("w5_zscore_ragged", f"""SELECT l_orderkey AS group_id, l_discount AS value,
  {O.r9('(l_discount - avg(l_discount) OVER w) / (stddev_samp(l_discount) OVER w + 0.0001)')} AS z
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def w5_zscore_ragged(spark, sf_dir):
    """W5 on ragged groups (lineitem orders; one-row groups give NULL)."""
    d = N.zscore(FX.ragged_groups(spark, sf_dir), "group_id", "value")
    return d.select("group_id", "value", r9("z").alias("z"))


@register("w5_zscore_tokens", f"""WITH {TOK}
SELECT seq_id, pos, {O.r9('(value - avg(value) OVER w) / (stddev_samp(value) OVER w + 0.0001)')} AS z
FROM tok WINDOW w AS (PARTITION BY seq_id)""")
def w5_zscore_tokens(spark, sf_dir):
    d = N.zscore(tokens_long(spark, sf_dir), "seq_id", "value")
    return d.select("seq_id", "pos", r9("z").alias("z"))


@register("w6_masked_zscore", f"""WITH {TOK},
st AS (SELECT seq_id, avg(CASE WHEN m <> 0 THEN value END) AS mu, stddev_samp(CASE WHEN m <> 0 THEN value END) AS sd,
              sum(CASE WHEN m <> 0 THEN 1 ELSE 0 END) AS n FROM tok GROUP BY seq_id)
SELECT seq_id, pos, {O.r9('CASE WHEN m <> 0 AND n >= 2 THEN (value - mu) / (sd + 0.0001) ELSE 0.0 END')} AS z
FROM tok JOIN st USING (seq_id)""")
def w6_masked_zscore(spark, sf_dir):
    d = N.masked_zscore(tokens_long(spark, sf_dir), "seq_id", "value", "m")
    return d.select("seq_id", "pos", r9("z").alias("z"))


@register("w7_masked_mean", f"""WITH {TOK}
SELECT seq_id, {O.r9('sum(value * m) / (sum(m) + 0.0001)')} AS masked_mean FROM tok GROUP BY seq_id""")
def w7_masked_mean(spark, sf_dir):
    d = N.masked_mean(tokens_long(spark, sf_dir), "seq_id", "value", "m")
    return d.select("seq_id", r9("masked_mean").alias("masked_mean"))


@register("w8_masked_min_max", f"""WITH {TOK},
st AS (SELECT seq_id, min(CASE WHEN m <> 0 THEN value END) AS mn, max(CASE WHEN m <> 0 THEN value END) AS mx
       FROM tok GROUP BY seq_id)
SELECT seq_id, pos, {O.r9('''CASE WHEN m <> 0 THEN (value - mn) / (CASE WHEN mx - mn = 0 THEN 1.0 ELSE mx - mn END)
  ELSE 0.0 END''')} AS scaled FROM tok JOIN st USING (seq_id)""")
def w8_masked_min_max(spark, sf_dir):
    d = N.masked_min_max(tokens_long(spark, sf_dir), "seq_id", "value", "m")
    return d.select("seq_id", "pos", r9("scaled").alias("scaled"))
