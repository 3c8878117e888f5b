"""Signal scoring over a long table `sig(entity, feature, value, severity)`.

One row per (entity, feature). Keep `sig` hash-partitioned on `entity`: every
per-entity step below then runs without another exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.functions import scores as S

CURVE_POINTS = [i / 20 for i in range(21)]  # percentiles 0, 5, ..., 100


def collect_signals(
    obs: DataFrame,
    entity: str,
    feature: str,
    domain: Sequence[str],
    measures: dict[str, Column],
    finish: dict[str, Column],
) -> DataFrame:
    """Long signals for a bounded feature domain with ONE exchange, keyed on the entity.

    Each measure is summed conditionally per feature inside a single
    `groupBy(entity)` (map-side combined, primitive buffers only), then the few
    feature slots are exploded locally. Grouping by (entity, feature) instead
    would leave a partitioning no later per-entity step can use.
    `finish` computes output columns from the summed measures and `n_obs`.
    """
    aggs = []
    for i, f in enumerate(domain):
        hit = F.col(feature) == f
        aggs.append(F.count(F.when(hit, F.lit(1))).alias(f"n_{i}"))
        aggs += [F.sum(F.when(hit, c)).alias(f"{m}_{i}") for m, c in measures.items()]
    wide = obs.filter(F.col(feature).isin(list(domain))).groupBy(F.col(entity).alias("entity")).agg(*aggs)
    slots = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"n_{i}").alias("n_obs"),
                *[F.col(f"{m}_{i}").alias(m) for m in measures],
            )
            for i, f in enumerate(domain)
        ]
    )
    long = wide.select("entity", F.explode(slots).alias("s")).select("entity", "s.*").filter("n_obs > 0")
    return long.select("entity", "feature", "n_obs", *[c.alias(n) for n, c in finish.items()])


def calibrate(sig: DataFrame, graded: Sequence[str]) -> DataFrame:
    """Population curve per graded feature: mean and 21 exact percentiles.

    Severities are four-decimal values in [0, 1], so the exact percentile buffer
    holds at most 10,001 counts per feature and combines map-side; the result
    has at most len(graded) rows, which is what makes it safe to broadcast.
    """
    sev = S.rnd(F.col("severity"), 4)
    return (
        sig.filter(F.col("feature").isin(list(graded)))
        .groupBy("feature")
        .agg(
            F.count("*").alias("n"),
            S.rnd(F.avg(sev), 6).alias("mean"),
            F.percentile(sev, F.array(*[F.lit(p) for p in CURVE_POINTS])).alias("q"),
        )
        .withColumn("q", F.transform("q", lambda x: S.rnd(x, 6)))
    )


def value_freq(sig: DataFrame, domain: Sequence[tuple[str, str]]) -> DataFrame:
    """Frequency of each in-domain (feature, value) among that feature's signals.

    At most len(domain) rows. The per-feature totals are a window over those few
    counts, not a second pass over the signals.
    """
    feats = sorted({f for f, _ in domain})
    per = sig.filter(F.col("feature").isin(feats)).groupBy("feature", "value").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    out = per.withColumn("freq", F.col("n") / F.sum("n").over(W.partitionBy("feature")))
    keep = [F.lit(f"{f}={v}") for f, v in domain]
    return out.filter(F.concat_ws("=", "feature", "value").isin(*keep))


def pctl_rank(sig: DataFrame, curves: DataFrame) -> DataFrame:
    """Add `rel`: percentile rank against the feature's curve (missing curve = absolute)."""
    c = F.broadcast(curves.select("feature", F.col("q").alias("_q")))
    return sig.join(c, "feature", "left").withColumn("rel", S.curve_rank(F.col("severity"), F.col("_q"))).drop("_q")


def cat_weight(sig: DataFrame, freq: DataFrame) -> DataFrame:
    """Add `rel`: rarity of the categorical value (unseen values get the default frequency)."""
    f = F.broadcast(freq.select("feature", "value", F.col("freq").alias("_f")))
    return sig.join(f, ["feature", "value"], "left").withColumn("rel", S.rnd(S.rarity(F.col("_f")), 6)).drop("_f")


def readings(sig: DataFrame, features: DataFrame, curves: DataFrame, freq: DataFrame, zone_cut: float = 0.5) -> DataFrame:
    """One reading per signal with its distinctiveness and whether it is surfaced.

    `features(feature, kind, ...)` decides the treatment: graded and extra signs
    rank against the curve, categorical signs weigh rarity, zone signs carry
    their severity and are present at or above `zone_cut`.
    """
    sev = F.col("severity")
    kind = F.col("kind")
    return (
        sig.join(features, "feature")
        .join(F.broadcast(curves.select("feature", F.col("q").alias("_q"))), "feature", "left")
        .join(F.broadcast(freq.select("feature", "value", F.col("freq").alias("_f"))), ["feature", "value"], "left")
        .withColumn(
            "rel",
            F.when(kind.isin("graded", "extra"), S.curve_rank(sev, F.col("_q")))
            .when(kind == "categorical", S.rnd(S.rarity(F.col("_f")), 6))
            .otherwise(sev),
        )
        .withColumn(
            "mentioned",
            F.when(kind.isin("graded", "extra"), F.col("rel") >= S.MENTION_REL)
            .when(kind == "categorical", F.lit(True))
            .otherwise(sev >= zone_cut),
        )
        .drop("_q", "_f")
    )


def notable(read: DataFrame) -> DataFrame:
    """Distinctive readings only; a categorical sign counts when it is not the default value."""
    return read.filter(
        F.when(F.col("kind") == "categorical", F.col("value") != F.col("default_value")).otherwise(F.col("mentioned"))
    )


def derive_axes(probs: DataFrame, p_mid: str = "p2", p_top: str = "p3") -> DataFrame:
    """Split a three-class compositional reading into two binary axes.

    thickness: thick carries `p_top`; texture: greasy carries `p_mid + p_top`.
    Above 0.5 decides; confidence is the mass of the chosen side, severity the
    mass of the abnormal side.
    """
    thick, greasy = F.col(p_top), F.col(p_mid) + F.col(p_top)

    def axis(name: str, p: Column, yes: str, no: str) -> Column:
        return F.struct(
            F.lit(name).alias("axis"),
            F.when(p > 0.5, F.lit(yes)).otherwise(F.lit(no)).alias("value"),
            F.when(p > 0.5, p).otherwise(F.lit(1.0) - p).alias("confidence"),
            p.alias("severity"),
        )

    keep = [c for c in probs.columns if c not in ("p1", p_mid, p_top)]
    slots = F.array(axis("thickness", thick, "thick", "thin"), axis("texture", greasy, "greasy", "smooth"))
    return probs.select(*keep, F.explode(slots).alias("a")).select(*keep, "a.*")


def summary_lines(sig: DataFrame, labels: DataFrame) -> DataFrame:
    """Compact per-entity text: `label: value (nn%)`, in label order.

    The collected list holds one item per feature of the entity, so it is
    bounded by the feature vocabulary.
    """
    pct = F.floor(F.col("severity") * 100 + F.lit(0.5)).cast("int")
    line = F.format_string("%s: %s (%d%%)", F.col("label"), F.col("value"), pct)
    return (
        sig.join(labels.select("feature", "label"), "feature")
        .groupBy("entity")
        .agg(F.array_sort(F.collect_list(line)).alias("l"))
        .select("entity", F.array_join("l", "; ").alias("summary"))
    )


def softmax_score(df: DataFrame, logits: str, domain: Sequence[str], measured: Column | None = None) -> DataFrame:
    """Class value, confidence and ordinal severity from a logit array.

    With a measured severity the degree is an even blend of the two.
    """
    names = F.array(*[F.lit(d) for d in domain])
    out = df.withColumn("probs", S.softmax(F.col(logits)))
    best = F.array_position(F.col("probs"), F.array_max("probs")).cast("int")
    sev = S.expected_ordinal(F.col("probs"))
    sev = sev if measured is None else F.lit(0.5) * sev + F.lit(0.5) * measured
    return out.select(
        *df.columns,
        F.element_at(names, best).alias("value"),
        F.array_max("probs").alias("confidence"),
        sev.alias("severity"),
        "probs",
    )


def sigmoid_score(df: DataFrame, logits: str, features: Sequence[str]) -> DataFrame:
    """Multi-label presence: sigmoid above 0.5 is present, the probability is the severity."""
    names = F.array(*[F.lit(f) for f in features])
    keep = [c for c in df.columns if c != logits]
    rows = df.select(*keep, F.posexplode(F.arrays_zip(names.alias("feature"), F.col(logits).alias("x"))))
    p = S.logistic(F.col("x"))
    return rows.select(*keep, F.col("col.feature").alias("feature"), F.col("col.x").cast("double").alias("x")).select(
        *keep,
        "feature",
        F.when(p > 0.5, F.lit("present")).otherwise(F.lit("absent")).alias("value"),
        p.alias("severity"),
    )


def quality_gate(df: DataFrame, coverage: Column, lo: float = 0.05, hi: float = 0.85) -> DataFrame:
    """Acceptance with a reason list: too little or implausibly much coverage is rejected."""
    reasons = F.array_compact(
        F.array(
            F.when(coverage < lo, F.lit("not detected or too small")),
            F.when(coverage > hi, F.lit("implausibly large")),
        )
    )
    return df.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def escalate(checks: Sequence[tuple[Column, str]]) -> tuple[Column, Column]:
    """Worst status of several checks, and the joined messages of those that are not ok.

    Each check is (status column in ok/warn/error, message).
    """
    rank = lambda c: F.when(c == "error", 2).when(c == "warn", 1).otherwise(0)
    worst = F.greatest(*[rank(c) for c, _ in checks]) if len(checks) > 1 else rank(checks[0][0])
    status = F.when(worst == 2, F.lit("error")).when(worst == 1, F.lit("warn")).otherwise(F.lit("ok"))
    text = F.array_join(F.array_compact(F.array(*[F.when(rank(c) > 0, F.lit(m)) for c, m in checks])), "; ")
    return status, text
