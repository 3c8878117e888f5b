"""Connected components of a link table, and a bounded filter of ids for narrow passes over large tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sigweave.llm.shingles import mixed
from sigweave.session import cut, release


#: rows of a task, and tasks at least, where tables of links are worked on
TASK_ROWS, TASKS = 20_000, 8


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """`df` in about as many tasks as its number of rows needs: small tables of links have no use for every shuffle partition."""
    return df.coalesce(max(TASKS, -(-rows // TASK_ROWS)))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links(a, b): the smallest id that can be reached.

    Labels spread to neighbours and then jump along themselves, so long chains take a logarithmic number of rounds; every
    round is one table in the shared folder. Ids without a link are not listed.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    n = both.count()
    both = few_tasks(both, n)
    labels = cut(few_tasks(both.groupBy("a").agg(F.min("b").alias("l")), n).select(F.col("a").alias("id"), F.least("a", "l").alias("component")))
    while True:
        near = few_tasks(both.join(labels.withColumnRenamed("id", "b"), "b"), n).groupBy("a").agg(F.min("component").alias("near"))
        nxt = few_tasks(labels.join(few_tasks(near, n).withColumnRenamed("a", "id"), "id"), n).select("id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        nxt = cut(nxt)
        to = nxt.select(F.col("id").alias("component"), F.col("component").alias("further"))
        jumped = nxt.join(to, "component", "left").select("id", F.least("component", "further").alias("component"), "old")
        nxt = cut(few_tasks(jumped, n))
        labels = nxt.select("id", "component")
        release(links.sparkSession)
        if nxt.where("component <> old").isEmpty():
            return labels


class IdFilter:
    """A bit per hashed id, of fixed size: ids of the table always pass, others pass by chance only.

    It spares a shuffle of large rows by ids; an exact join on the id must follow.
    """

    def __init__(self, ids: DataFrame, bits: int = 1 << 23):
        at = ids.select(F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(bits)).alias("h"))
        words = at.select(F.expr("cast(h div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("x"))
        rows = words.groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()  # bits / 64 rows at most
        self.words = np.zeros(bits // 64, np.int64)
        self.words[rows["w"].to_numpy()] = rows["x"].to_numpy()
        self.bits = bits

    def column(self, name: str):
        """The bit's number of an id column, to be tested by `passes`."""
        return F.pmod(F.xxhash64(F.col(name)), F.lit(self.bits))

    def passes(self, numbers: np.ndarray) -> np.ndarray:
        return (self.words[numbers // 64] >> (numbers % 64)) & 1 == 1


def packed(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0x5BD1E995)) % np.uint64(buckets)).astype(np.int64)
