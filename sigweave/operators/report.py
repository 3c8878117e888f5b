"""Output assembly: nested records, stripping attributions, chunk templating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigweave.functions.text import redact


def strip_external(df: DataFrame, col: str, drop: Sequence[str], blank: Sequence[str], texts: Sequence[str], text_lists: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Drop attribution fields, blank citation codes and redact every string of a struct column."""
    c = F.col(col).dropFields(*drop) if drop else F.col(col)
    for f in blank:
        c = c.withField(f, F.lit(""))
    for f in texts:
        c = c.withField(f, redact(F.col(f"{col}.{f}"), names))
    for f in text_lists:
        c = c.withField(f, F.transform(F.col(f"{col}.{f}"), lambda x: redact(x, names)))
    return df.withColumn(col, c)


def chunk_lists(df: DataFrame, by: Sequence[str], item: str, n: int) -> DataFrame:
    """First n items per key joined by ', ' (each task keeps at most n before the exchange)."""
    rn = F.row_number().over(W.partitionBy(*by).orderBy(item))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("items"))


def literal_argmax(text: Column, weights: Sequence[tuple[str, str, float]], default: str) -> Column:
    """Best outcome of a contained-keyword vote, ties to the later name; `default` without any vote."""
    by: dict[str, Column] = {}
    for word, outcome, w in weights:
        v = F.when(text.contains(word), F.lit(w)).otherwise(F.lit(0.0))
        by[outcome] = by[outcome] + v if outcome in by else v
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(o).alias("o")) for o, s in by.items()]))
    return F.when(best["s"] > 0, best["o"]).otherwise(F.lit(default))


def assemble(ranked: DataFrame, found: DataFrame, quality: DataFrame) -> DataFrame:
    """Nested result per entity: quality, ranked outcomes and findings, as one JSON document.

    Lists are bounded by k outcomes and the feature vocabulary.
    """
    o = ranked.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("rank", "outcome", "confidence"))).alias("outcomes"))
    f = found.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", "feature", "phrase", "prominence"))).alias("findings"))
    return quality.join(o, "entity", "left").join(f, "entity", "left").select("entity", F.to_json(F.struct("accepted", "outcomes", "findings")).alias("result"))
