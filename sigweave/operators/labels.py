"""Label engineering: manifests, guards, supervision targets, the long label store, splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.functions import scores as S
from sigweave.operators.ranking import hash_rank


def guard(df: DataFrame, domain: DataFrame) -> DataFrame:
    """Keep `value` only if (feature, value) is in the domain table, else NULL; adds its ordinal."""
    d = domain.select("feature", "value", F.col("ord"))
    return df.join(d, ["feature", "value"], "left").withColumn("value", F.when(F.col("ord").isNotNull(), F.col("value")))


def build_manifest(base: DataFrame, weak: DataFrame, gold: DataFrame, key: str, gold_cols: Sequence[str]) -> DataFrame:
    """Base rows with weak labels and sparse gold attached; `has_gold` = any gold value."""
    j = base.join(weak, key, "left").join(gold, key, "left")
    return j.withColumn("has_gold", F.coalesce(*gold_cols).isNotNull())


def resolve_target(df: DataFrame, auto: str, manual: str, domain: Sequence[str], gold_weight: float = 2.0) -> DataFrame:
    """Class index and supervision weight: valid manual (gold weight), else valid auto (1), else class 0 with weight 0."""
    idx = lambda c: F.array_position(F.array(*[F.lit(d) for d in domain]), F.col(c))
    m, a = F.coalesce(idx(manual), F.lit(0)), F.coalesce(idx(auto), F.lit(0))
    return df.withColumn("target", F.when(m > 0, m - 1).when(a > 0, a - 1).otherwise(F.lit(0)).cast("int")).withColumn(
        "weight", F.when(m > 0, F.lit(gold_weight)).when(a > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )


def area_severity(count: Column, area: Column) -> Column:
    """clip(count * area / 10, 0, 1), missing measurements counting as absent."""
    return S.clip(F.coalesce(count, F.lit(0.0)) * F.coalesce(area, F.lit(0.0)) / F.lit(10.0), 0.0, 1.0)


def coverage_severity(ratio: Column) -> Column:
    """clip((ratio - 10) / 200, 0, 1), missing = 0."""
    return F.coalesce(S.clip((ratio - F.lit(10.0)) / F.lit(200.0), 0.0, 1.0), F.lit(0.0))


POSITIVE = ["present", "few", "many", "mild", "strong", "yes"]
NEGATIVE = ["none", "no", "absent"]


def to_presence(value: Column) -> Column:
    """Graded or ordinal wording to present / absent (NULL stays NULL)."""
    return F.when(value.isin(NEGATIVE), F.lit("absent")).when(value.isNotNull(), F.lit("present"))


def scope(labels: DataFrame, source: str, split: str | None = None, features: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Labels of one source, optionally one split, a feature list, and the first-N sorted entities.

    The entity cap is the feature itself (an evaluation budget): a top-N over
    distinct ids, taken per task before any exchange.
    """
    d = labels.filter(F.col("source") == source)
    if split is not None:
        d = d.filter(F.col("split") == split)
    if features is not None:
        d = d.filter(F.col("feature").isin(list(features)))
    if limit is not None:
        d = d.join(d.select("entity").distinct().orderBy("entity").limit(limit), "entity", "left_semi")
    return d


def label_store(parts: Sequence[tuple[DataFrame, dict[str, str], str]], key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Long label store from wide sources: (frame, {feature: column}, source name) each.

    Wide to long is an `unpivot` per source; NULL labels are not supervised and drop.
    """
    out = []
    for df, cols, src in parts:
        wide = df.select(F.col(key).alias("entity"), *keep, *[F.col(c).cast("string").alias(f) for f, c in cols.items()])
        long = wide.unpivot(["entity", *keep], list(cols), "feature", "value").filter("value is not null")
        out.append(long.withColumn("source", F.lit(src)))
    return reduce(DataFrame.unionByName, out)


def union_datasets(parts: Sequence[tuple[DataFrame, str]], tag: str = "src") -> DataFrame:
    """Union of frames with missing columns (NULL = not supervised), tagged with their origin."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn(tag, F.lit(t)) for d, t in parts]
    )


def agreement(store: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of two sources on (entity, feature) with whether they agree; one grouped pass, no self-join.

    A source has one value per (entity, feature).
    """
    side = lambda s: F.max(F.when(F.col("source") == s, F.col("value")))
    p = store.filter(F.col("source").isin(a, b)).groupBy("entity", "feature").agg(side(a).alias("va"), side(b).alias("vb"))
    return p.filter("va is not null and vb is not null").withColumn("agree", F.col("va") == F.col("vb"))


def merge_labels(sets: Sequence[tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Core and extra label maps of several sets under a set prefix; extra overrides core.

    Each set: (core(id, labels map), extra(id, labels map), prefix).
    """
    out = []
    for core, extra, prefix in sets:
        j = core.select("id", F.col("labels").alias("c")).join(extra.select("id", F.col("labels").alias("e")), "id", "left")
        merged = F.when(F.col("e").isNull(), F.col("c")).otherwise(
            F.map_concat(F.map_filter("c", lambda k, v: ~F.map_contains_key(F.col("e"), k)), F.col("e"))
        )
        out.append(j.select(F.concat_ws("-", F.lit(prefix), "id").alias("id"), merged.alias("labels")))
    return reduce(DataFrame.unionByName, out)


def members(merged: DataFrame, domain: DataFrame) -> DataFrame:
    """(feature, ord, value, id): who carries each value of the domain, values in domain order. Long rows, since a value may be very common."""
    long = merged.select("id", F.explode("labels").alias("feature", "value"))
    return long.join(domain, ["feature", "value"]).select("feature", "ord", "value", "id")


def composite_tag(labels: Column, order: Sequence[str], short: dict[str, str]) -> Column:
    """`short-value` of the features that have a value, in the given order, joined by two underscores."""
    part = lambda f: F.when(F.coalesce(labels[f], F.lit("")) != "", F.concat(F.lit(short.get(f, f) + "-"), labels[f]))
    return F.concat_ws("__", *[part(f) for f in order])


def stratified_split(df: DataFrame, key: str, stratum: Column, fracs: dict, seed: int = 42) -> DataFrame:
    """Reproducible split by md5 order inside each stratum: test first, then val, rest train.

    `fracs`: {stratum value: (test, val)}; the counts are floored. Strata of any
    size spread over 4,096 hash slices.
    """
    d = df.withColumn("_st", stratum).withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    r = hash_rank(d, ["_st"], "_h", key)
    pick = lambda i: reduce(lambda acc, kv: acc.when(F.col("_st") == F.lit(kv[0]), F.floor(F.col("n") * F.lit(kv[1][i]))), list(fracs.items())[1:], F.when(F.col("_st") == F.lit(list(fracs)[0]), F.floor(F.col("n") * F.lit(list(fracs.values())[0][i]))))
    t, v = pick(0), pick(1)
    return r.withColumn("split", F.when(F.col("rn") <= t, "test").when(F.col("rn") <= t + v, "val").otherwise("train")).drop("_st", "_h", "rn", "n")


def coverage(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Zero-filled crosstab of counts; the pivot values are given, so one pass suffices."""
    return df.groupBy(row).pivot(col, list(values)).count().na.fill(0)


def class_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, class, n) of the non-null classes of several columns, counted map-side in one pass."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "class")
    return long.filter("class is not null").groupBy("column", "class").agg(F.count("*").alias("n"))


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: non-null count and number of classes, from the class counts instead of a distinct aggregate per column."""
    return class_counts(df, cols).groupBy("column").agg(F.sum("n").alias("n_non_null"), F.count("*").alias("n_classes"))


def multi_hot(obs: DataFrame, key: str, class_col: str, classes: dict[int, str]) -> DataFrame:
    return obs.groupBy(key).agg(*[F.max(F.when(F.col(class_col) == k, 1).otherwise(0)).alias(n) for k, n in classes.items()])


def crosswalk(labels: DataFrame, meta: DataFrame, key: str, path: str, default: Column) -> DataFrame:
    """Attach the path of an id from the set's metadata, else a default path."""
    return labels.join(meta.select(key, F.col(path).alias("_p")), key, "left").withColumn("path", F.coalesce("_p", default)).drop("_p")


def vocabulary(kb: DataFrame, feature: str, value: str) -> DataFrame:
    """Feature to its sorted allowed values, `present` when it lists none.

    Values are made distinct before they are listed, so the list is the vocabulary.
    """
    d = kb.select(F.col(feature).alias("feature"), F.col(value).alias("value")).distinct()
    return d.groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("v")).select(
        "feature", F.when(F.size("v") == 0, F.array(F.lit("present"))).otherwise(F.col("v")).alias("allowed")
    )
