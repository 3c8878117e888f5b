"""Exact percentiles of any doubles in groups of any size by radix selection.

A double becomes a 64-bit number of the same order. One pass counts the upper 16 bits per group, map-side; the wanted ranks
fall into a few of these digits, and the next pass counts the next 16 bits of only the rows there. After four passes the number is known. A
task holds counts, never values: a group that has all rows, or a million distinct values, needs no more memory.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.dims import checked_broadcast
from sigweave.session import cut

DIGITS = 16


@F.pandas_udf(T.LongType())
def _ordered(x: pd.Series) -> pd.Series:
    """Doubles as longs of the same order; -0.0 counts as 0.0."""
    bits = (x.to_numpy("float64") + 0.0).view("int64")
    return pd.Series(bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF))


@F.pandas_udf(T.DoubleType())
def _value(k: pd.Series) -> pd.Series:
    bits = k.to_numpy("int64")
    return pd.Series((bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)).view("float64"))


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """(keys, rank, value): the value at each wanted 0-based rank; ranks(keys, rank) has few rows per group.

    NULL and NaN values take no part.
    """
    keys = list(keys)
    x = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    rows = cut(x.select(*keys, _ordered("_v").alias("_k")))
    open_ = ranks.select(*keys, "rank", F.col("rank").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    for done in range(0, 64, DIGITS):
        digit = F.shiftrightunsigned("_k", 64 - DIGITS - done).bitwiseAND(F.lit((1 << DIGITS) - 1)).cast("long")
        if not done:  # the sign bit of the first digit is turned, so that digits ascend with the values
            digit = digit.bitwiseXOR(F.lit(1 << DIGITS - 1))
        here = rows.select(*keys, "_k", digit.alias("_d"))
        if done:  # only rows under a prefix that a rank has led to
            here = here.withColumn("_prefix", F.shiftright("_k", 64 - done)).join(checked_broadcast(open_.select(*keys, "_prefix").distinct()), [*keys, "_prefix"])
        else:
            here = here.withColumn("_prefix", F.lit(0).cast("long"))
        n = here.groupBy(*keys, "_prefix", "_d").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys, "_prefix").orderBy("_d").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        cells = n.withColumn("_before", before)
        hit = open_.join(cells, [*keys, "_prefix"]).filter("_left >= _before and _left < _before + _n")
        top = F.col("_d") if done else F.shiftright(F.shiftleft(F.col("_d").bitwiseXOR(F.lit(1 << DIGITS - 1)), 48), 48)
        prefix = F.shiftleft("_prefix", DIGITS).bitwiseOR(top) if done else top
        open_ = cut(hit.select(*keys, "rank", (F.col("_left") - F.col("_before")).alias("_left"), prefix.alias("_prefix")))
    return open_.select(*keys, "rank", _value("_prefix").alias("value"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, share, value) with linear interpolation between the two ranks around share * (n - 1)."""
    keys = list(keys)
    n = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg(F.count("*").alias("_n"))
    at = n.select(*keys, "_n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("_at", F.col("share") * (F.col("_n") - 1))
    at = cut(at.withColumn("_lo", F.floor("_at")).withColumn("_hi", F.ceil("_at")))
    ranks = at.select(*keys, F.explode(F.array("_lo", "_hi")).alias("rank")).distinct()
    found = at_ranks(df, keys, value, ranks)
    side = lambda c: found.select(*keys, F.col("rank").alias(c), F.col("value").alias(f"{c}v"))
    j = at.join(side("_lo"), [*keys, "_lo"]).join(side("_hi"), [*keys, "_hi"])
    between = F.col("_lov") + (F.col("_hiv") - F.col("_lov")) * (F.col("_at") - F.col("_lo"))
    return j.select(*keys, "share", F.when(F.col("_lo") == F.col("_hi"), F.col("_lov")).otherwise(between).alias("value"))
