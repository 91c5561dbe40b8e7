"""Token-level column functions on stored arrays.

A row is one sequence: ``input_ids`` (length L) and log-prob arrays aligned
with ``input_ids[1:]`` (length L-1). Everything is a higher-order function
(``transform``, ``zip_with``, ``aggregate``) evaluated inside the row: no
explode, no shuffle, arrays stay ragged (no padding).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KL_ESTIMATORS = ("k1", "k2", "k3")


def prefix_mask(ids: Column, assistant_id) -> Column:
    """1 after the last ``assistant_id``; all 0 when it is absent."""
    p = F.array_position(F.reverse(ids), F.lit(assistant_id))
    last = F.size(ids) - p + 1                       # 1-based index of the last match
    return F.transform(ids, lambda x, i: F.when((p > 0) & (i + 1 > last), 1).otherwise(0))


def suffix_mask(ids: Column, eos_id) -> Column:
    """1 up to and including the first ``eos_id``; all 1 when absent."""
    first = F.array_position(ids, F.lit(eos_id))
    return F.transform(ids, lambda x, i: F.when((first == 0) | (i + 1 <= first), 1).otherwise(0))


def loss_mask(ids: Column, assistant_id, eos_id) -> Column:
    """(T1 * T2) without its first element (aligned with log-probs)."""
    m = F.zip_with(prefix_mask(ids, assistant_id), suffix_mask(ids, eos_id), lambda a, b: a * b)
    return F.when(F.size(ids) >= 2, F.slice(m, 2, F.size(ids) - 1)).otherwise(F.array().cast("array<int>"))


def log_softmax_gather(logits: Column, target: Column) -> Column:
    """T4 (re-aimed on stored logits): log_softmax(x)[target], target 0-based.

    x[t] - max - ln(sum(exp(x - max))), the usual stable form."""
    m = F.array_max(logits)
    s = F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))
    return F.try_element_at(logits, target + 1) - m - F.log(s)


def pad_or_truncate(a: Column, n: int) -> Column:
    """T5: first n values, zero-padded to length n."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), n)), 1, n)


def ratio(new: Column, old: Column) -> Column:
    """exp(new - old) per token."""
    return F.zip_with(new, old, lambda a, b: F.exp(a - b))


def clip(r: Column, eps_low: float, eps_high: float) -> Column:
    return F.least(F.greatest(r, F.lit(1.0 - eps_low)), F.lit(1.0 + eps_high))


def surrogate(rho: Column, adv: Column, eps_low: float, eps_high: float) -> Column:
    """-min(rho A, clip(rho) A) per token."""
    return F.transform(rho, lambda r: -F.least(r * adv, clip(r, eps_low, eps_high) * adv))


def clipped_flags(rho: Column, adv: Column, eps_low: float, eps_high: float) -> Column:
    """T12's indicator: 1 where rho A < clip(rho) A (the reference's rule)."""
    return F.transform(rho, lambda r: F.when(r * adv < clip(r, eps_low, eps_high) * adv, 1.0).otherwise(0.0))


def clip_active_flags(rho: Column, adv: Column, eps_low: float, eps_high: float) -> Column:
    """Q4's companion: 1 where the clipped term is the one the min picks
    (clip(rho) A < rho A), i.e. where clipping actually bounds the loss."""
    return F.transform(rho, lambda r: F.when(clip(r, eps_low, eps_high) * adv < r * adv, 1.0).otherwise(0.0))


def approx_kl(logp: Column, base: Column, estimator: str = "k1") -> Column:
    """k1 = d, k2 = d^2/2, k3 = exp(-d) - 1 + d with d = logp - base."""
    if estimator not in KL_ESTIMATORS:
        raise ValueError(f"unknown KL estimator {estimator!r}; expected one of {KL_ESTIMATORS}")
    if estimator == "k1":
        return F.zip_with(logp, base, lambda a, b: a - b)
    if estimator == "k2":
        return F.zip_with(logp, base, lambda a, b: (a - b) * (a - b) / 2.0)
    return F.zip_with(logp, base, lambda a, b: F.exp(b - a) - 1.0 + (a - b))


def add_scaled(a: Column, b: Column, beta: float) -> Column:
    """A + beta * b (only built when beta > 0)."""
    return F.zip_with(a, b, lambda x, y: x + F.lit(beta) * y)


def masked_sum(values: Column, mask: Column) -> Column:
    """sum(v * m); arrays of different lengths are refused, since a value would
    be missing for some token. A NULL array gives NULL."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: F.coalesce(v * m, F.lit(0.0))),
                        F.lit(0.0), lambda acc, x: acc + x)
    return (F.when(values.isNull() | mask.isNull(), F.lit(None).cast("double"))
             .when(F.size(values) == F.size(mask), total)
             .otherwise(F.raise_error(F.lit("log-probs and mask differ in length")).cast("double")))


def mask_sum(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda acc, x: acc + x)


def surprise(logp: Column, mask: Column) -> Column:
    """(1 - exp(logp)) * mask per token."""
    return F.zip_with(logp, mask, lambda lp, m: (F.lit(1.0) - F.exp(lp)) * m)
