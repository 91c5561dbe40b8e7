"""Entry 3 on stored arrays: masks -> ratio -> clipped surrogate (+ beta KL)
-> per-sequence sums -> per-batch loss, completion length, KL, clip ratio.

Per-sequence work is a narrow projection (higher-order functions inside the
row). Per-batch reductions are ``groupBy(batch)`` with partial aggregation,
so a large batch is reduced map-side before its one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import tokens as TK


def sequence_terms(seqs: DataFrame, assistant_id=4, eos_id=5, beta: float = C.BETA,
                   eps_low: float = C.EPSILON_LOW, eps_high: float = C.EPSILON_HIGH,
                   kl_estimator: str = C.KL_ESTIMATOR, new: str = "logp", old: str = "old_logp",
                   ref: str = "ref_logp") -> DataFrame:
    """T3, T6-T9, T10-T12 numerators per sequence.

    Adds mask, s_mask (= completion length), s_loss, seq_loss (NULL when the
    mask is empty: skipped by the batch average, counted in n_empty), s_clip
    and, when beta > 0 or KL is asked for, s_kl. With beta = 0 the plan
    never touches the reference log-probs (no join, no column read).
    """
    adv = F.col("advantage")
    d = seqs.withColumn("mask", TK.loss_mask(F.col("input_ids"), assistant_id, eos_id))
    d = d.withColumn("_rho", TK.ratio(F.col(new), F.col(old)))
    loss = TK.surrogate(F.col("_rho"), adv, eps_low, eps_high)
    if beta > 0.0:
        d = d.withColumn("_kl", TK.approx_kl(F.col(new), F.col(ref), kl_estimator))
        loss = TK.add_scaled(loss, F.col("_kl"), beta)
    d = d.withColumn("_loss", loss)
    d = d.withColumn("s_mask", TK.mask_sum(F.col("mask")))
    d = d.withColumn("s_loss", TK.masked_sum(F.col("_loss"), F.col("mask")))
    d = d.withColumn("seq_loss", F.try_divide(F.col("s_loss"), F.col("s_mask").cast("double")))
    d = d.withColumn("s_clip", TK.masked_sum(TK.clipped_flags(F.col("_rho"), adv, eps_low, eps_high),
                                             F.col("mask")))
    d = d.withColumn("s_clip_active", TK.masked_sum(TK.clip_active_flags(F.col("_rho"), adv, eps_low, eps_high),
                                                    F.col("mask")))
    if beta > 0.0:
        d = d.withColumn("s_kl", TK.masked_sum(F.col("_kl"), F.col("mask")))
    return d.drop("_rho", "_loss", "_kl")


def batch_metrics(terms: DataFrame, batch_size: int = C.PER_DEVICE_BATCH,
                  order: str = "seq_id", with_kl: bool = False) -> DataFrame:
    """T10, T11, T12, G7 per training batch (``floor(seq_id / batch_size)``)."""
    b = terms.withColumn("batch", F.floor(F.col(order) / F.lit(batch_size)).cast("long"))
    aggs = [F.avg("seq_loss").alias("loss"),
            F.sum(F.col("seq_loss").isNull().cast("int")).alias("n_empty"),
            F.avg("s_mask").alias("completion_length"),
            F.try_divide(F.sum("s_clip"), F.sum("s_mask").cast("double")).alias("clip_ratio"),
            F.try_divide(F.sum("s_clip_active"), F.sum("s_mask").cast("double")).alias("clip_active_ratio"),
            F.count(F.lit(1)).alias("n_seqs")]
    if with_kl:
        aggs.append(F.avg(F.col("s_kl") / (F.col("s_mask") + F.lit(C.MASKED_EPS))).alias("kl"))
    return b.groupBy("batch").agg(*aggs)


def interval_metrics(metrics: DataFrame, keys=("run", "log_step")) -> DataFrame:
    """Average every metric over its log interval (then reset)."""
    return metrics.groupBy(*keys, "metric").agg(F.avg("value").alias("value"),
                                                F.count(F.lit(1)).alias("n"))


def chunk_state(logits: Column, offset: Column, target: Column) -> Column:
    """What a chunk of a position's logits adds to its log-softmax: the chunk's
    maximum, the sum of exp(x - maximum), and the target's logit if it is here."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.when(x == F.lit(float("-inf")), 0.0).otherwise(F.exp(x - top)))
    here = (target >= offset) & (target < offset + F.size(logits))
    return F.struct(top.alias("top"), total.alias("total"), F.when(here, F.get(logits, (target - offset).cast("int"))).alias("hit"))


def merged_logp(states: Column) -> Column:
    """log softmax at the target from the states of all chunks of a position,
    in any order: the sums are scaled to the common maximum as they meet."""
    def merge(a, s):
        top = F.greatest(a["top"], s["top"])
        scaled = lambda x: F.when(x["total"] > 0, x["total"] * F.exp(x["top"] - top)).otherwise(F.lit(0.0))
        return F.struct(top.alias("top"), (scaled(a) + scaled(s)).alias("total"), F.coalesce(a["hit"], s["hit"]).alias("hit"))
    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("hit"))
    return F.aggregate(states, start, merge, lambda a: F.when(a["total"] > 0, a["hit"] - a["top"] - F.log(a["total"])))


def per_token_logps(chunks: DataFrame, sequences: DataFrame | None = None, key: str = "seq_id") -> DataFrame:
    """T4 for every token: (key, pos, logp), the log-probability of token pos + 1
    after the tokens up to pos, from stored logits of T positions and V ids.

    ``chunks``: key, pos, offset, logits (the ids offset, offset + 1 ...): a
    position's logits may span any number of rows, so a row need not hold a
    whole vocabulary. The target is the column ``target`` of the chunks, or
    else token pos + 1 of ``sequences`` (key, input_ids). Every chunk is
    reduced to three numbers before the shuffle; a position's states are as
    many as its chunks. Ids that are masked out (logit -inf) add nothing; a
    target outside the chunks, or without a logit, gives NULL."""
    d = chunks
    if sequences is not None:
        d = d.join(sequences.select(key, "input_ids"), key)
        d = d.withColumn("target", F.get("input_ids", (F.col("pos") + 1).cast("int"))).where(F.col("pos") + 1 < F.size("input_ids"))
    doubles = F.transform("logits", lambda x: x.cast("double"))
    d = d.where(F.size("logits") > 0).select(key, "pos", "offset", "target", doubles.alias("logits"))
    d = d.select(key, "pos", chunk_state(F.col("logits"), F.col("offset"), F.col("target")).alias("state"))
    return d.groupBy(key, "pos").agg(F.collect_list("state").alias("states")).select(key, "pos", merged_logp(F.col("states")).alias("logp"))
