"""Ranks, running sums and neighbours inside groups of any size.

A window partitioned by a hot key puts that whole key in one task. Here rows are
range-partitioned on (group, order) with a unique tie-break, so a hot group
spreads over many tasks; only one small total per (group, partition) is windowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigweave.dims import checked_broadcast
from sigweave.session import cut


def sorted_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows in (keys, order), dealt over range partitions and stored, with their place `_mid` and partition `_pid`.

    They are materialised once (`cut`) because the partition ids used for totals must be the ones the rows carry.
    Select narrow columns first; `order` must end in a unique column.
    """
    by = [*[F.col(k) for k in keys], *order]
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id()))
    return placed.withColumn("_pid", F.shiftright("_mid", 33))


def numbered(rows: DataFrame, base: DataFrame, keys: Sequence[str], place: str, rank_col: str, size_col: str | None = None) -> DataFrame:
    """`rows` of sorted rows with their 1-based number among `base` per group, without another exchange.

    Places of a group are consecutive inside a partition, so a row's number is its place less the first one, plus the
    rows in earlier partitions: one small total per (group, partition).
    """
    keys = list(keys)
    totals = base.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    before = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    size = [F.sum("_n").over(W.partitionBy(*keys)).alias(size_col)] if size_col else []
    offs = cut(totals.select(*keys, "_pid", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *size))
    j = rows.join(checked_broadcast(offs), [*keys, "_pid"])
    return j.withColumn(rank_col, (F.col(place) - F.col("_first") + 1 + F.col("_before")).cast("bigint")).drop("_first", "_before")


def distributed_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank_col: str = "rn", size_col: str | None = None) -> DataFrame:
    """Add a 1-based row number per group, with one range exchange. `order` must end in a unique column."""
    placed = sorted_rows(df, keys, order)
    ranked = numbered(placed, placed, keys, "_mid", rank_col, size_col)
    return ranked.select(*df.columns, rank_col, *([size_col] if size_col else []))


def hash_rank(df: DataFrame, keys: Sequence[str], hash_hex: str, tie: str, rank_col: str = "rn", size_col: str = "n") -> DataFrame:
    """Row number per group in hash order, plus the group size, without any sort of a whole group.

    The first three hex digits cut every group into 4,096 even slices (a pure
    function of the row, so nothing needs materialising): slice counts give the
    offsets, and only one slice is ever sorted in one task.
    """
    keys = list(keys)
    d = df.withColumn("_b", F.substring(hash_hex, 1, 3))
    counts = d.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offs = counts.select(
        *keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_on"), F.sum("_n").over(W.partitionBy(*keys)).alias(size_col)
    )
    rn = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(hash_hex, tie))
    return (
        d.withColumn("_rn", rn)
        .join(offs, [*keys, "_b"])
        .withColumn(rank_col, (F.col("_rn") + F.col("_on")).cast("bigint"))
        .drop("_b", "_rn", "_on")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """First row per key by `order`. The rank-limited window keeps one row per key in
    every task before the exchange, so a hot key arrives as one row per task."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").select(*keys, *cols)


def previous_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], col: str, out: str) -> DataFrame:
    """`lag(col)` inside groups of any size: rank, then an equi self-join on (key, rank - 1).

    The join key is unique per row, so a group holding a third of all rows still
    hashes evenly.
    """
    ranked = distributed_rank(df, keys, order)
    prev = ranked.select(*keys, (F.col("rn") + 1).alias("rn"), F.col(col).alias(out))
    return ranked.join(prev, [*keys, "rn"], "left").drop("rn")
