"""Exact top-k by inner product with vector-approximation files.

Candidate vectors lie in blocks. A block keeps, beside its exact integers, an approximation file: every component's
cell number on a grid of `2 ** bits` cells per dimension. For a query the whole approximation file is scanned for upper
bounds of the product (the smallest possible distance in the product's order); exact vectors are then read in the order
of these bounds, until the kth exact score is above every bound that is left. Ties at the kth score are read as well, so
the result is exact, ties included.

The work is a grid of (candidate block, query block) pairs, one task each: a stated query set against all rows. Blocks
have a bounded number of rows, so a task's memory does not grow with the input. Only k rows of a query leave a task.

Defined results: rows with a null id, null vectors, null or non-finite components take no part; ids are unique (of
repeated rows with one id the smallest vector stays); vectors of another length than the query's are no candidates of
it; empty vectors score 0 among themselves. Products and sums are exact at any size: where 64 bits might not hold them,
Python integers do, and the order follows them; a score that no long can hold is shown as the nearest long. The query
scales components by 256 first; a vector with one that is then no finite double takes no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sigweave.llm.vectors import finite, ids, one_row_per_id, top_k

#: bytes of a score as a sortable number: products of any doubles, added up
KEY = 272


def approximate(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers of every component, and the lowest and highest value of each (dimension, cell)."""
    cells, low, high = 1 << bits, values.min(0), values.max(0)
    with np.errstate(over="ignore", invalid="ignore"):
        share = (values - low) / np.where(high > low, high - low, 1.0)
    codes = np.clip(np.nan_to_num(share) * cells, 0, cells - 1).astype(np.uint8)
    floor, ceiling = (np.empty((values.shape[1], cells)) for _ in range(2))
    for c in range(cells):
        own = codes == c
        floor[:, c], ceiling[:, c] = np.where(own, values, np.inf).min(0), np.where(own, values, -np.inf).max(0)
    return codes, floor, ceiling


def upper_bounds(queries: np.ndarray, codes: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
    """(query, candidate) bounds: each component contributes its cell's end that suits the query's sign."""
    dims = np.arange(codes.shape[1])
    q = queries.astype(np.float64)
    lows, highs = floor[dims, codes], ceiling[dims, codes]
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(q, 0) @ highs.T + np.minimum(q, 0) @ lows.T
        # rounding is bounded by the sum of the absolute products
        bound += (np.abs(q) @ np.maximum(np.abs(lows), np.abs(highs)).T) * 1e-12 + 0.5
    return np.where(np.isnan(bound), np.inf, bound)


def whole_numbers(queries: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices as 64-bit integers where all products and sums fit, as Python integers otherwise."""
    with np.errstate(over="ignore"):
        most = np.abs(queries.astype(float)).max(0, initial=0) @ np.abs(values.astype(float)).max(0, initial=0)
    if most < 2.0**62 and max(np.abs(queries.astype(float)).max(initial=0), np.abs(values.astype(float)).max(initial=0)) < 2.0**62:
        return queries.astype(np.int64), values.astype(np.int64)
    return tuple(np.array([int(x) for x in m.ravel().tolist()], object).reshape(m.shape) for m in (queries, values))


def search_block(qid: np.ndarray, queries: np.ndarray, vid: np.ndarray, values: np.ndarray, k: int, bits: int = 4):
    """The k best (query, id, score) of one block for each query; reads exact rows only while a bound can still win."""
    if values.shape[1] == 0:
        bound = np.zeros((len(qid), len(vid)))
    else:
        bound = upper_bounds(queries, *approximate(values.astype(np.float64), bits))
    asks, exact = whole_numbers(queries, values)
    out_q, out_v, out_s = [], [], []
    first = min(len(vid), 8 * k)
    for i in range(len(qid)):
        b, have_v, have_s = bound[i], np.empty(0, np.int64), np.empty(0, exact.dtype)
        order = np.argpartition(-b, first - 1)[:first] if first < len(vid) else np.arange(len(vid))
        done = vid == qid[i]  # a row is no candidate of itself
        todo = order[~done[order]]
        while len(todo):
            have_v = np.concatenate([have_v, vid[todo]])
            have_s = np.concatenate([have_s, exact[todo] @ asks[i]])
            best = np.lexsort((have_v, -have_s))[:k]
            have_v, have_s = have_v[best], have_s[best]
            done[todo] = True
            sure = float(have_s[-1]) if len(have_s) == k and abs(have_s[-1]) < 1 << 1000 else -np.inf
            left = np.flatnonzero((b >= sure) & ~done)
            if len(left) > 4 * first:  # the best bounds first; the next kth score may rule out the rest
                left = left[np.argpartition(-b[left], 4 * first)[: 4 * first]]
            todo = left
        out_q.append(np.full(len(have_v), qid[i]))
        out_v.append(have_v)
        out_s.append(have_s)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _cell(k: int, bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v, s = [np.empty(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            rows = [(ids(t["id"]), t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)) for t in (right, left)]
            q, v, s = search_block(*rows[0], *rows[1], k, bits)
        key = [(int(x) + (1 << 8 * KEY - 1)).to_bytes(KEY, "big") for x in s]
        return pa.table({"query_id": q, "vec_id": v, "key": pa.array(key, pa.binary())})

    return run


def _scores(batches):
    """The score of each key; a long has no place for more than 63 bits, so its nearest value stands there."""
    for b in batches:
        s = [int.from_bytes(x, "big") - (1 << 8 * KEY - 1) for x in b["key"].to_pylist()]
        s = pa.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in s], pa.int64())
        yield pa.RecordBatch.from_arrays([b["query_id"], b["rank"], b["vec_id"], s], ["query_id", "rank", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, k: int, every: int, bits: int = 4, block: int = 8192, queries_per_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of vectors(id, v) whose id is divisible by `every`.

    Components are whole numbers, as bigint or as double (then of any size).
    """
    rows = one_row_per_id(vectors.where(F.col("id").isNotNull() & finite(F.col("v"))), "id", "v")
    rows = rows.withColumn("dim", F.size("v"))
    queries = rows.where(F.col("id") % every == 0)
    n = rows.count()
    blocks, qblocks = max(1, -(-n // block)), max(1, -(-queries.count() // queries_per_block)) if n else 1
    c = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    q = queries.withColumn("q", F.pmod(F.xxhash64(F.col("id") + 1), F.lit(qblocks)).cast("int"))
    q = q.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    key = ["dim", "b", "q"]
    part = c.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(_cell(k, bits), "query_id long, vec_id long, key binary")
    best = top_k(part, k, F.col("key").desc(), F.col("vec_id")).select("query_id", "rank", "vec_id", "key")
    return best.mapInArrow(_scores, "query_id long, rank int, vec_id long, score long")


def op10_va_search(spark, sf_dir: str) -> DataFrame:
    from sigweave.session import table

    e = table(spark, sf_dir, "embeddings").where(finite(F.col("embedding")))
    times = lambda x: x.cast("double") * 256.0  # noqa: E731  a double from 2**52 on is whole
    scaled = F.transform("embedding", lambda x: F.when(F.abs(times(x)) < 2.0**52, F.floor(times(x)).cast("double")).otherwise(times(x)))
    return exact_top_k(e.select(F.col("vec_id").alias("id"), scaled.alias("v")), k=5, every=50)


OP10_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
