"""Evaluators over prediction/gold pairs. Confusion counts come first: they combine
map-side, and every metric is arithmetic on that small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigweave.functions import scores as S
from sigweave.operators.ranking import numbered, sorted_rows


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def score_pairs(pred: DataFrame, gold: DataFrame, domain: DataFrame) -> DataFrame:
    """(entity, feature, pred, gold) only where gold exists and is in the domain."""
    g = gold.join(domain.select("feature", "value"), ["feature", "value"], "left_semi")
    return pred.select("entity", "feature", F.col("value").alias("pred")).join(
        g.select("entity", "feature", F.col("value").alias("gold")), ["entity", "feature"]
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts per (feature, gold, pred) with the share of the gold class (recall on the diagonal)."""
    c = pairs.groupBy("feature", "gold", "pred").agg(F.count("*").alias("n"))
    return c.withColumn("share", S.rnd(F.col("n") / F.sum("n").over(W.partitionBy("feature", "gold")), 6))


def per_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 (0 where undefined) of every class seen in gold or prediction, with its counts."""
    c = pairs.groupBy("feature", "gold", "pred").agg(F.count("*").alias("n"))
    side = lambda col, tp: c.groupBy("feature", F.col(col).alias("cls")).agg(
        F.sum("n").alias(f"n_{col}"), *([F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp")] if tp else [])
    )
    per = side("gold", True).join(side("pred", False), ["feature", "cls"], "full_outer").na.fill(0)
    p, r = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_gold"))
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return per.withColumn("p", p).withColumn("r", r).withColumn("f1", f1)


def multiclass(pairs: DataFrame) -> DataFrame:
    """Accuracy and macro precision / recall / F1 per feature over classes seen in gold or prediction."""
    return per_class(pairs).groupBy("feature").agg(
        F.sum("n_gold").alias("n"),
        S.rnd(F.sum("tp") / F.sum("n_gold"), 6).alias("accuracy"),
        S.rnd(F.avg("p"), 6).alias("macro_p"),
        S.rnd(F.avg("r"), 6).alias("macro_r"),
        S.rnd(F.avg("f1"), 6).alias("macro_f1"),
    )


def binary_prf(pairs: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Presence P / R / F1 and positive rate from boolean `pred`, `gold`."""
    n = lambda c: F.count(F.when(c, 1))
    p, g = F.col("pred"), F.col("gold")
    a = pairs.groupBy(*by).agg(n(p & g).alias("tp"), n(p & ~g).alias("fp"), n(~p & g).alias("fn"), n(~p & ~g).alias("tn"))
    prec, rec = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return a.withColumn("precision", S.rnd(prec, 6)).withColumn("recall", S.rnd(rec, 6)).withColumn(
        "f1", S.rnd(ratio(2 * prec * rec, prec + rec), 6)
    ).withColumn("pos_rate", S.rnd(ratio(F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6))


def average_precision(scored: DataFrame, key: str) -> DataFrame:
    """AP per feature: mean of precision@i over positives, by score descending, id on ties.

    `scored(feature, key, score, g)` with g in 0/1; NULL without positives. Rows are sorted
    and stored once; positives get their number among all rows and among positives from
    totals per partition, so one feature holding most rows does not end in one task.
    """
    rows = sorted_rows(scored.select("feature", key, "score", "g"), ["feature"], [F.col("score").desc(), F.col(key)])
    pos = rows.filter("g = 1").withColumn("_place", F.monotonically_increasing_id())
    hits = numbered(numbered(pos, rows, ["feature"], "_mid", "rn"), pos, ["feature"], "_place", "tp")
    ap = hits.groupBy("feature").agg(S.rnd(F.avg(F.col("tp") / F.col("rn")), 6).alias("ap"))
    return rows.groupBy("feature").agg(F.count("*").alias("n"), F.sum("g").alias("n_pos")).join(ap, "feature", "left")


def macro_map(ap: DataFrame, least: int = 20) -> DataFrame:
    """Rows flagged `reliable` from `least` positives on, and the mean AP over those as one more row named MACRO."""
    flagged = ap.withColumn("reliable", F.col("n_pos") >= least)
    mean = [F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"), S.rnd(F.avg("ap"), 6).alias("ap")]
    return flagged.unionByName(flagged.filter("reliable").agg(F.lit("MACRO").alias("feature"), *mean).withColumn("reliable", F.lit(True)))


def sweep_counts(scored: DataFrame, grid: Sequence[float], by: Sequence[str] = ("feature",), strict: bool = True) -> DataFrame:
    """tp / fp / fn per threshold without multiplying rows by the grid.

    Each row falls into one slot = number of thresholds it passes; slot counts
    combine map-side and are accumulated over at most len(grid) + 1 slots.
    """
    s = F.col("score")
    passed = [(s > t) if strict else (s >= t) for t in grid]
    slot = sum((p.cast("int") for p in passed[1:]), passed[0].cast("int"))
    c = scored.withColumn("_slot", F.coalesce(slot, F.lit(0))).groupBy(*by, "_slot").agg(
        F.sum("g").cast("bigint").alias("_p"), F.count("*").alias("_n")
    )
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(grid)]))
    x = c.select(*by, "_slot", "_p", "_n", steps.alias("t")).select(*by, "_slot", "_p", "_n", "t.*")
    hit = F.col("_slot") > F.col("i")
    return x.groupBy(*by, "threshold").agg(
        F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("_n") - F.col("_p")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("_p"))).alias("fn"),
    )


def with_prf(c: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumn("precision", S.rnd(p, 6)).withColumn("recall", S.rnd(r, 6)).withColumn("f1", S.rnd(ratio(2 * p * r, p + r), 6))


def best_f1(scored: DataFrame, grid: Sequence[float], by: Sequence[str] = ("feature",)) -> DataFrame:
    """Threshold with the best F1 (lowest on ties; 0.5 if nothing beats zero)."""
    m = with_prf(sweep_counts(scored, grid, by))
    b = m.groupBy(*by).agg(F.max(F.struct(F.col("f1").alias("f1"), (-F.col("threshold")).alias("t"), "precision", "recall")).alias("b"))
    none = F.col("b.f1") <= 0
    return b.select(
        *by,
        F.when(none, F.lit(0.5)).otherwise(-F.col("b.t")).alias("threshold"),
        F.col("b.f1").alias("f1"),
        F.when(none, F.lit(0.0)).otherwise(F.col("b.precision")).alias("precision"),
        F.when(none, F.lit(0.0)).otherwise(F.col("b.recall")).alias("recall"),
    )


def suggested_cut(scored: DataFrame, grid: Sequence[float], by: Sequence[str] = ("feature",)) -> DataFrame:
    """The grid's cut with the best F1, the lowest of equals (the first one if no cut finds anything)."""
    m = with_prf(sweep_counts(scored, grid, by))
    b = m.groupBy(*by).agg(F.max(F.struct(F.col("f1").alias("f1"), (-F.col("threshold")).alias("t"))).alias("b"))
    return b.select(*by, (-F.col("b.t")).alias("cut"), F.col("b.f1").alias("f1"))


def grade_means(sig: DataFrame) -> DataFrame:
    """Mean signal per gold grade (separation check)."""
    return sig.groupBy("feature", "gold").agg(F.count("*").alias("n"), S.rnd(F.avg("score"), 6).alias("mean_score"))


def fair_accuracy(pairs: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Exact, within-one-grade and presence agreement from ordinals `p_ord`, `g_ord` (0 = absent)."""
    p, g = F.col("p_ord"), F.col("g_ord")
    rate = lambda c: S.rnd(F.avg(c.cast("int")), 6)
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), rate(p == g).alias("exact"), rate(F.abs(p - g) <= 1).alias("within1"), rate((p == 0) == (g == 0)).alias("presence")
    )


def by_domain(pairs: DataFrame, dims: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*dims).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("pred") == F.col("gold"), 1)).alias("n_ok"), S.rnd(F.avg((F.col("pred") == F.col("gold")).cast("int")), 6).alias("accuracy")
    )


def scenario_matrix(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Accuracy per (scenario, config) with both margins and the total, from one cube."""
    return (
        pairs.groupBy(a, b, "ok")
        .agg(F.count("*").alias("n"))
        .cube(a, b)
        .agg(F.sum("n").alias("n"), S.rnd(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"), F.grouping_id().cast("int").alias("level"))
    )


def faithfulness(claims: DataFrame, entities: DataFrame, gate: float = 0.85) -> DataFrame:
    """Micro (sum/sum) and macro (mean of per-entity ratios, no claims = 1) support with a gate."""
    per = claims.groupBy("entity").agg(F.count("*").alias("c"), F.sum("supported").alias("s"))
    j = entities.join(per, "entity", "left").na.fill(0, ["c", "s"])
    micro = F.when(F.sum("c") == 0, F.lit(1.0)).otherwise(F.sum("s") / F.nullif(F.sum("c"), F.lit(0)))
    macro = F.avg(F.when(F.col("c") == 0, F.lit(1.0)).otherwise(F.col("s") / F.nullif(F.col("c"), F.lit(0))))
    return j.agg(
        F.count("*").alias("n_cases"),
        F.sum("c").alias("claims"),
        F.sum("s").alias("supported"),
        S.rnd(micro, 6).alias("micro"),
        S.rnd(macro, 6).alias("macro"),
        F.when(micro >= gate, "PASS").otherwise("FAIL").alias("gate"),
    )


TAUS = [i / 10 for i in range(31)]


def tau_confusion(rows: DataFrame, log_prior: Sequence[float]) -> DataFrame:
    """(split, tau, gold, pred, n) of argmax(logit - tau * ln prior) for every tau.

    `rows(split, gold int, logits array)`. Only these counts leave the map side.
    """
    lp = F.array(*[F.lit(float(x)) for x in log_prior])
    adj = lambda t: F.zip_with("logits", lp, lambda x, l: S.rnd(x - t * l, 9))
    preds = F.explode(F.transform(F.array(*[F.lit(t) for t in TAUS]), lambda t: F.struct(t.alias("tau"), (F.array_position(adj(t), F.array_max(adj(t))) - 1).alias("pred"))))
    x = rows.select("split", "gold", preds.alias("p")).select("split", "gold", "p.*")
    return x.groupBy("split", "tau", "gold", "pred").agg(F.count("*").alias("n"))


def tau_scores(m: DataFrame, n_classes: int, minority: int) -> DataFrame:
    """(split, tau, macro_f1, minority_recall) from the confusion counts."""
    x = m.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
    g, p, c, n = F.col("gold"), F.col("pred"), F.col("cls"), F.col("n")
    total = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    per = x.groupBy("split", "tau", "cls").agg(total((g == c) & (p == c)).alias("tp"), total(g == c).alias("ng"), total(p == c).alias("np"))
    f1 = ratio(2 * F.col("tp"), F.col("ng") + F.col("np"))
    return per.groupBy("split", "tau").agg(
        S.rnd(F.avg(f1), 9).alias("macro_f1"), S.rnd(F.max(F.when(c == minority, ratio(F.col("tp"), F.col("ng")))), 6).alias("minority_recall")
    )


def fit_tau(scores: DataFrame) -> float:
    """Tau with the best validation macro-F1; the smallest on ties (so 0 wins them)."""
    b = scores.filter("split = 'val'").agg(F.max(F.struct("macro_f1", (-F.col("tau")).alias("t"))).alias("b")).first()["b"]
    return abs(b["t"])


def tau_report(scores: DataFrame, tau: float) -> DataFrame:
    """Macro-F1 and minority recall before (tau 0) and after, per split."""
    at = lambda t, c: F.max(F.when(F.col("tau") == t, F.col(c)))
    return scores.groupBy("split").agg(
        F.lit(tau).alias("tau"), at(0.0, "macro_f1").alias("base_f1"), at(tau, "macro_f1").alias("best_f1"),
        at(0.0, "minority_recall").alias("base_recall"), at(tau, "minority_recall").alias("best_recall"),
    )
