"""Scalar scoring expressions. Every function maps columns to a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scoring constants the results depend on.
PRESENT_FLOOR = 0.12  # a severity below this is never distinctive
CURVE_TOP_MIN = 0.2  # a curve whose maximum is lower carries no population information
ABS_LO, ABS_SPAN = 0.3, 0.7  # absolute fallback (severity - 0.3) / 0.7
RARITY_MIN, RARITY_UNSEEN = 0.1, 0.3  # weight floor, assumed frequency of an unseen value
SATURATION = 1.2  # confidence = score / (score + 1.2)
BALANCED_CUT = 0.55  # below this best score the balanced outcome leads
MENTION_REL = 0.6  # a graded sign is surfaced at or above this rank
LOGODDS_STEP = 1.4  # log-odds per unit of answer weight
PROB_EPS = 1e-3


def rnd(c: Column, digits: int) -> Column:
    """Round half up with plain double arithmetic (same bits on any engine)."""
    p = float(10**digits)
    return F.floor(c * F.lit(p) + F.lit(0.5)) / F.lit(p)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def curve_rank(sev: Column, q: Column) -> Column:
    """Percentile rank of `sev` on an ascending quantile curve `q` (array of n+1 points).

    Below the floor: 0. No curve, or a curve with a maximum under 0.2: rank by
    absolute severity. Otherwise piecewise linear; above the maximum: 1. A
    severity under the first point would extrapolate below zero and is clamped.
    """
    steps = F.size(q) - 1
    i = F.size(F.filter(F.slice(q, 2, steps), lambda x: x < sev))
    lo, hi = F.get(q, i), F.get(q, i + 1)
    frac = F.when(hi <= lo, F.lit(0.0)).otherwise((sev - lo) / F.nullif(hi - lo, F.lit(0.0)))
    inside = F.greatest(F.lit(0.0), rnd((i + frac) * (F.lit(100.0) / steps) / F.lit(100.0), 4))
    absolute = rnd(clip((sev - F.lit(ABS_LO)) / F.lit(ABS_SPAN), 0.0, 1.0), 4)
    return (
        F.when(sev < PRESENT_FLOOR, F.lit(0.0))
        .when(q.isNull() | (F.element_at(q, -1) < CURVE_TOP_MIN), absolute)
        .when(i >= steps, F.lit(1.0))
        .otherwise(inside)
    )


def rarity(freq: Column) -> Column:
    """Informativeness of a categorical value: 1 - frequency, floored."""
    return F.greatest(F.lit(RARITY_MIN), F.lit(1.0) - F.coalesce(freq, F.lit(RARITY_UNSEEN)))


def saturate(score: Column) -> Column:
    return score / (score + F.lit(SATURATION))


def logit(p: Column) -> Column:
    q = clip(p, PROB_EPS, 1 - PROB_EPS)
    return F.log(q / (F.lit(1.0) - q))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logodds_update(confidence: Column, evidence: Column) -> Column:
    """`evidence` is the signed sum of answer weights (+w for yes, -w for no)."""
    return logistic(logit(confidence) + F.lit(LOGODDS_STEP) * evidence)


def softmax(logits: Column) -> Column:
    """Numerically stable softmax over an array of doubles."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def expected_ordinal(probs: Column) -> Column:
    """Sum of i * p_i over (n - 1): a graded degree in [0, 1]."""
    total = F.aggregate(
        F.zip_with(probs, F.sequence(F.lit(0), F.size(probs) - 1), lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x
    )
    return total / (F.size(probs) - 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def percentile_phrase(rel: Column, on_curve: Column) -> Column:
    """Distinctiveness wording for signs graded on a population curve, else ''."""
    p = F.floor(rel * 100 + F.lit(0.5)).cast("int")
    return (
        F.when(~on_curve | rel.isNull(), F.lit(""))
        .when(p >= 85, F.format_string("more pronounced than ~%d%% of entities", p))
        .when(p >= 70, F.format_string("more pronounced than most (top ~%d%%)", F.lit(100) - p))
        .otherwise(F.lit(""))
    )


def first_band(value: Column, bands: Sequence[tuple[float, str]]) -> Column:
    """Word of the first band whose maximum is >= value, else the last band's word."""
    out = None
    for top, word in bands:
        out = F.when(value <= top, F.lit(word)) if out is None else out.when(value <= top, F.lit(word))
    return out.otherwise(F.lit(bands[-1][1]))


def fixed2(c: Column) -> Column:
    """A number as text with two decimals, halves away from zero."""
    cents = F.floor(F.abs(c) * 100 + F.lit(0.5)).cast("bigint")
    sign = F.when((c < 0) & (cents > 0), "-").otherwise("")
    return F.concat(sign, F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
