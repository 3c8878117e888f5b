"""Quota sampling, exemplar picking, rarity weights and reproducible resampling."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.functions import scores as S
from sigweave.operators.ranking import sorted_rows


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def unit_hash(text: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def quota_sample(df: DataFrame, key: str, quotas: Sequence[tuple[str, str, int]], n: int, seed: int = 11) -> DataFrame:
    """(key, pick, picked_by): a greedy cover of (column, class, quota) cells, topped up in hash order to n rows.

    Each pick is the row that counts towards most cells still open, the first in hash order among equals, until n rows are
    picked or no row helps; then rows not picked yet follow in hash order. Rows with the same cells are interchangeable
    but for their order, so the first n of each set of cells decide the outcome exactly: rank-limited windows keep these
    in every task, and what one task then goes through is n rows per set of cells, whatever the size of the table.
    """
    cells = F.concat(*[F.when(F.col(c) == v, "1").otherwise("0") for c, v, _ in quotas])
    h = df.select(key, hash_order(key, seed).alias("_h"), cells.alias("_cells"))
    rn = F.row_number().over(W.partitionBy("_cells").orderBy("_h", key))
    few = h.withColumn("_rn", rn).filter(F.col("_rn") <= n)
    limits = [q for _, _, q in quotas]

    def pick(rows: pa.Table) -> pa.Table:
        order = rows.sort_by([("_h", "ascending"), (key, "ascending")])
        sets: dict[str, list[int]] = {}
        for i, c in enumerate(order["_cells"].to_pylist()):
            sets.setdefault(c, []).append(i)
        queue = {c: iter(x) for c, x in sets.items()}
        ahead = {c: next(x) for c, x in queue.items()}
        open_, picks = list(limits), []
        gain = lambda c: sum(bit == "1" and left > 0 for bit, left in zip(c, open_, strict=True))
        while ahead and len(picks) < n:
            best = max(ahead, key=lambda c: (gain(c), -ahead[c]))
            if not gain(best):
                break
            picks.append(ahead.pop(best))
            open_ = [left - (bit == "1" and left > 0) for bit, left in zip(best, open_, strict=True)]
            if (following := next(queue[best], None)) is not None:
                ahead[best] = following
        covered, taken = len(picks), set(picks)
        picks += [i for i in range(order.num_rows) if i not in taken][: n - covered]
        by = ["quota"] * covered + ["fill"] * (len(picks) - covered)
        return pa.table([order[key].take(pa.array(picks, pa.int64())), pa.array(range(1, len(picks) + 1), pa.int32()), pa.array(by, pa.string())], names=[key, "pick", "picked_by"])

    schema = T.StructType([df.schema[key], T.StructField("pick", T.IntegerType()), T.StructField("picked_by", T.StringType())])
    return few.groupBy().applyInArrow(pick, schema)


def greedy_picks(cands: DataFrame, key: str, order: Sequence[Column], n_targets: int) -> DataFrame:
    """One row per target, targets served in order, each taking its best row not used before.

    `cands(target int, key, ...)`. A target can lose at most n_targets - 1 rows to
    earlier ones, so its first n_targets rows decide the outcome exactly: those
    n_targets^2 rows are folded in one ordered pass.
    """
    rn = F.row_number().over(W.partitionBy("target").orderBy(*order, F.col(key)))
    few = cands.withColumn("rn", rn).filter(F.col("rn") <= n_targets).select("target", F.col("rn"), F.col(key).cast("string").alias("k"))
    acc0 = F.array().cast("array<struct<target:int,k:string>>")
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col("target").cast("int").alias("target"), "rn", "k"))),
        acc0,
        lambda acc, x: F.when(
            F.exists(acc, lambda p: (p["target"] == x["target"]) | (p["k"] == x["k"])), acc
        ).otherwise(F.concat(acc, F.array(F.struct(x["target"].alias("target"), x["k"].alias("k"))))),
    )
    return few.agg(F.explode(fold).alias("p")).select("p.target", F.col("p.k").alias(key))


def rarity_weights(df: DataFrame, domains: dict[str, Sequence[str]], hi: float = 15.0) -> DataFrame:
    """Weight = max over columns of n_major / n_class, clipped to [1, hi].

    Counts of the listed classes are joined back by broadcast (at most one row per
    listed class), one lookup per column; the rows themselves are never shuffled.
    Classes outside the domain weigh 1.
    """
    out, cols = df, list(domains)
    for c in cols:
        n = df.filter(F.col(c).isin(list(domains[c]))).groupBy(c).agg(F.count("*").alias("_n"))
        w = n.select(c, (F.max("_n").over(W.partitionBy(F.lit(1))) / F.col("_n")).alias(f"_w_{c}"))
        out = out.join(F.broadcast(w), c, "left")
    top = F.greatest(F.lit(1.0), *[F.coalesce(F.col(f"_w_{c}"), F.lit(1.0)) for c in cols])
    return out.withColumn("weight", F.least(F.lit(hi), top)).drop(*[f"_w_{c}" for c in cols])


def class_weights(counts: DataFrame, mode: str = "sqrt", lo: float = 0.5, hi: float = 4.0) -> DataFrame:
    """Per-class loss weight: none / inv / sqrt of the count, normalised to mean 1 per feature, clipped.

    `counts(feature, value, n)` lists every class of the domain, zero counts as 1.
    """
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    raw = F.lit(1.0) if mode == "none" else F.lit(1.0) / (n if mode == "inv" else F.sqrt(n))
    mean = F.avg("_raw").over(W.partitionBy("feature"))
    return counts.withColumn("_raw", raw).withColumn("weight", S.clip(F.col("_raw") / mean, lo, hi)).drop("_raw")


def pos_weight(pos: Column, neg: Column, hi: float = 15.0) -> Column:
    return S.clip(neg / F.greatest(pos, F.lit(1)), 1.0, hi)


def resample(df: DataFrame, key: str, weight: str, n: int, seed: int, share: int = 1000) -> DataFrame:
    """(draw, key): n draws with replacement in proportion to the weights (counted in millionths).

    Every row owns a stretch of the running sum of weights; draw number i is a hash-made point on it. Points meet
    stretches in cells that hold about `share` draws each, so the lookup is an equi join and a comparison inside cells.
    """
    rows = sorted_rows(df.select(key, F.floor(F.col(weight) * 1e6 + 0.5).cast("bigint").alias("_w")).filter("_w > 0"), [], [F.col(key)])
    total = rows.agg(F.sum("_w").alias("t")).first()["t"] or 0
    sums = rows.groupBy("_pid").agg(F.sum("_w").alias("_s"))  # a row per partition
    before = F.coalesce(F.sum("_s").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    run = F.sum("_w").over(W.partitionBy("_pid").orderBy("_mid").rowsBetween(W.unboundedPreceding, 0))
    own = rows.withColumn("_run", run).join(F.broadcast(sums.select("_pid", before.alias("_before"))), "_pid")
    width = max(1, total // max(1, n // share))
    own = own.select(key, (F.col("_run") + F.col("_before") - F.col("_w")).alias("_lo"), (F.col("_run") + F.col("_before")).alias("_hi"))
    cells = F.sequence(F.expr(f"_lo div {width}"), F.expr(f"(_hi - 1) div {width}"))
    own = own.withColumn("_cell", F.explode(cells))
    point = F.floor(unit_hash(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"))) * float(total)).cast("bigint")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), point.alias("_u")).withColumn("_cell", F.expr(f"_u div {width}"))
    return draws.join(own, "_cell").filter("_u >= _lo and _u < _hi").select("draw", key)


def name_pool(df: DataFrame, reject: str, name: Column) -> DataFrame:
    """Pool of all rows whose name does not match `reject`."""
    return df.filter(~name.rlike(reject))
