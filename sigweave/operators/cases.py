"""Golden-case handling: compact case specs to full signals, and mapping checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigweave.functions import scores as S


def synth_probs(cases: DataFrame, domain: Sequence[str], top: float = 0.8) -> DataFrame:
    """Class probabilities for each case feature: `top` on its value, the rest shared.

    The domain is a literal list exploded in place, so this is a narrow map.
    """
    rest = (1 - top) / (len(domain) - 1)
    rest = round(rest, 12)
    return cases.select("entity", "feature", "value", F.explode(F.array(*[F.lit(d) for d in domain])).alias("class_value")).select(
        "entity", "feature", "class_value", F.when(F.col("class_value") == F.col("value"), F.lit(top)).otherwise(F.lit(rest)).alias("p")
    )


def synth_signals(
    cases: DataFrame,
    domains: dict[str, Sequence[str]],
    severities: dict[str, dict[str, float]],
    extras: Sequence[str],
    zones: dict[str, tuple[Sequence[str], str, float]],
    extra_severity: tuple[float, float] = (0.85, 0.05),
) -> DataFrame:
    """Compact case specs `(entity, feature, value)` to full signals `(entity, feature, value, severity)`.

    Every case gets all core features (first domain value when unstated; severity from
    `severities`, else the ordinal position) and all extras (present / absent). `zones`:
    feature -> (stated values that count, reported value, severity), only when stated.
    The spec is folded to one map per case, then all signals are a local explode.
    """
    m = cases.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    said = lambda f: F.try_element_at(F.col("m"), F.lit(f))
    row = lambda f, v, s: F.struct(F.lit(f).alias("feature"), v.alias("value"), s.cast("double").alias("severity"))
    rows = []
    for f, dom in domains.items():
        v = F.coalesce(said(f), F.lit(dom[0]))
        sev = F.lit(0.0)
        for i, d in enumerate(dom):
            sev = F.when(v == d, F.lit(float(severities.get(f, {}).get(d, i / (len(dom) - 1))))).otherwise(sev)
        rows.append(row(f, v, sev))
    for f in extras:
        on = F.coalesce(said(f) == "present", F.lit(False))
        rows.append(row(f, F.when(on, "present").otherwise("absent"), F.when(on, extra_severity[0]).otherwise(extra_severity[1])))
    for f, (stated, value, sev) in zones.items():
        rows.append(F.when(said(f).isin(list(stated)), row(f, F.lit(value), F.lit(sev))))
    return m.select("entity", F.explode(F.array_compact(F.array(*rows))).alias("s")).select("entity", "s.*")


def axis_signals(sig: DataFrame, feature: str, mid: str, top: str, names: tuple[tuple[str, str, str], ...], p: float = 0.8) -> DataFrame:
    """Display axes of a compositional feature synthesised at confidence `p`: (axis, abnormal, normal) names for
    the top class alone and for the two upper classes together."""
    q = (1 - p) / 2
    (a1, hi1, lo1), (a2, hi2, lo2) = names
    v = F.col("value")
    p_top = F.when(v == top, p).otherwise(q)
    p_any = F.when(v.isin(mid, top), p + q).otherwise(2 * q)
    mk = lambda a, x, hi, lo: F.struct(F.lit(a).alias("feature"), F.when(x > 0.5, hi).otherwise(lo).alias("value"), x.alias("severity"))
    s = F.array(mk(a1, p_top, F.lit(hi1), F.lit(lo1)), mk(a2, p_any, F.lit(hi2), F.lit(lo2)))
    return sig.filter(F.col("feature") == feature).select("entity", F.explode(s).alias("s")).select("entity", "s.*")


def mapping_accuracy(ranked: DataFrame, accept: DataFrame, balanced: str = "balanced") -> DataFrame:
    """One row: cases and how many have their top outcome in the accept set.

    `ranked(entity, outcome, rank)`, `accept(entity, outcome)`. A leading
    balanced filler is skipped unless it is itself accepted.
    """
    ok_bal = accept.filter(F.col("outcome") == balanced).select("entity").distinct().withColumn("_b", F.lit(1))
    r = ranked.join(ok_bal, "entity", "left")
    n = F.count("*").over(W.partitionBy("entity"))
    skip = (F.col("outcome") == balanced) & F.col("_b").isNull() & (n > 1)
    top = r.withColumn("_skip", skip).filter(~F.col("_skip")).groupBy("entity").agg(F.min_by("outcome", "rank").alias("outcome"))
    hit = top.join(accept.withColumn("_h", F.lit(1)), ["entity", "outcome"], "left")
    return hit.agg(
        F.count("*").alias("n"), F.count("_h").alias("n_ok"), S.rnd(F.count("_h") / F.count("*"), 6).alias("accuracy")
    )


def expected_in_top(ranked: DataFrame, expected: DataFrame, k: int = 2) -> DataFrame:
    """One row: how many entities have their expected outcome among the first k."""
    hits = ranked.filter(F.col("rank") <= k).join(expected, ["entity", "outcome"]).select("entity").distinct()
    e = expected.select("entity").distinct().join(hits.withColumn("_h", F.lit(1)), "entity", "left")
    return e.agg(F.count("*").alias("n"), F.count("_h").alias("n_ok"))
