"""Approximate nearest neighbours by multiprobe p-stable hashing.

`tables` hash tables take `hashes` projections each, a . v / width + b with Gaussian a; a row's bucket is the tuple of
floors. A query visits perturbed buckets in the order of their estimated success: the probability, for a neighbour at the
fitted distance r, to fall into the bucket given where the query lies in its own. Probing of a table stops when the
visited probabilities reach the share that all tables together need for `success`. Candidates of all tables are merged
and ranked by the exact distance in double precision.

r is the median distance to the 10th neighbour in a sample of at most `sample` distinct vectors (by hash of the id; a larger
table has nearer neighbours, so the sample errs towards more probes). Queries that met fewer than k rows, or whose kth is
farther than `far` * r, where probes are no longer likely to succeed, are answered by an exact scan in blocks. Every row is indexed. Of exact copies of one vector the
k + 1 smallest ids are enough for every query (ties go to the smaller id), so a vector shared by a third of all rows costs
k + 1 rows. Buckets over `bucket_rows` rows are dealt over several groups, to which the probes are repeated. The rows of a bucket meet
the queries that visit it in one matrix product, which leaves out those that are surely not among the k nearest of that query.

Defined results: rows with null ids, null, zero or empty vectors, null or non-finite components take no part; of repeated
ids the smallest vector stays; only vectors of the query's length are candidates; fewer candidates give fewer ranks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sigweave.dims import checked_broadcast
from sigweave.llm.vectors import finite, ids, matrix, one_row_per_id, top_k
from sigweave.session import cut

ERF = np.frompyfunc(math.erf, 1, 1)
#: rows and queries of a matrix product, pairs whose distances are taken together
ROWS, QUERIES, PAIRS = 2048, 512, 1 << 15
#: no query row, id and distance
NOTHING = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def projections(seed: int, table: int, hashes: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((seed, table, dim))
    return rng.normal(size=(dim, hashes)), rng.uniform(0, 1, hashes)


def bucket_keys(cells: np.ndarray, table: int, dim: int) -> np.ndarray:
    """One long for each row of cell numbers."""
    h = np.full(len(cells), (table * 1_000_003 + dim + 1) * 0x9E3779B1, np.int64)
    for j in range(cells.shape[1]):
        h = (h ^ cells[:, j]) * np.int64(0x5851F42D4C957F2D - (1 << 63)) + np.int64(0x14057B7EF767814F)
        h ^= (h >> 29) & np.int64(0x7FFFFFFFF)
    return h


def probe_cells(q: np.ndarray, scale: float, share: float, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, cells) of every probe, likeliest first, until their probabilities sum to `share`.

    q: projected queries (in widths); scale: width / r.
    """
    home = np.floor(q)
    steps = np.arange(-reach, reach + 1)
    edge = (np.arange(-reach, reach + 2)[None, None, :] - (q - home)[:, :, None]) * scale / math.sqrt(2)
    p = np.diff(0.5 * ERF(edge).astype(np.float64), axis=2)
    rows, cells = [], []
    for i in range(len(q)):
        joint = p[i, 0]
        for j in range(1, q.shape[1]):
            joint = np.multiply.outer(joint, p[i, j])
        flat = joint.ravel()
        order = np.argsort(-flat, kind="stable")
        upto = int(np.searchsorted(np.cumsum(flat[order]), share)) + 1
        at = np.stack(np.unravel_index(order[:upto], joint.shape), 1)
        cells.append(home[i].astype(np.int64) + steps[at])
        rows.append(np.full(len(at), i))
    return np.concatenate(rows), np.concatenate(cells)


def fit_radius(sample: np.ndarray, k: int = 10, queries: int = 256) -> float:
    """Median distance to the kth other row of the sample."""
    if len(sample) < 2:
        return 1.0
    d = np.stack([np.sqrt(((sample - x) ** 2).sum(1)) for x in sample[:queries]])
    kth = np.sort(d, 1)[:, min(k, len(sample) - 1)]
    r = float(np.median(kth)) or float(d.mean())
    return r if r > 0 else 1.0


def _keyed(radius: dict[int, float], seed: int, tables: int, hashes: int, width: float, whole: bool):
    """The buckets of every row, one in each table; with `whole` beside its id and vector."""

    def run(batches):
        for b in batches:
            for dim in np.unique(ids(b["dim"])):
                sub = b.filter(pa.array(ids(b["dim"]) == dim))
                x = matrix(sub["v"], np.float64)
                keys = np.empty((len(x), tables), np.int64)
                for t in range(tables):
                    a, o = projections(seed, t, hashes, int(dim))
                    cells = np.floor(x @ a / (width * radius.get(int(dim), 1.0)) + o).astype(np.int64)
                    keys[:, t] = bucket_keys(cells, t, int(dim))
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([sub["id"], sub["v"], buckets] if whole else [buckets], ["id", "v", "buckets"] if whole else ["buckets"])

    return run


def _probe(radius: dict[int, float], seed: int, tables: int, hashes: int, width: float, share: float):
    reach = math.ceil(2.6 / width)

    def run(batches):
        for b in batches:
            for dim in np.unique(ids(b["dim"])):
                sub = b.filter(pa.array(ids(b["dim"]) == dim))
                x, own = matrix(sub["v"], np.float64), ids(sub["id"])
                for t in range(tables):
                    a, o = projections(seed, t, hashes, int(dim))
                    row, cells = probe_cells(x @ a / (width * radius.get(int(dim), 1.0)) + o, width, share, reach)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(cells, t, int(dim))), pa.array(own[row])], ["bucket", "query_id"])

    return run


def closest(x: np.ndarray, own: np.ndarray, q: np.ndarray, qid: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance) of the k nearest rows x of each query q, but for rows farther than the square root of `bar`.

    One matrix product gives all squared distances up to its rounding error. Rows that are farther than k others by more than
    that error are left out; the distances of the rest are then taken component by component, and ties go to the smaller id.
    """
    with np.errstate(over="ignore", invalid="ignore"):  # what is no number is never left out
        xx, qq = (x * x).sum(1), (q * q).sum(1)
        near = np.c_[q, np.ones(len(q))] @ np.c_[-2 * x, xx].T  # squared distances less qq
        error = 8 * (x.shape[1] + 8) * np.finfo(np.float64).eps * (qq + xx.max()) + 1e-300
        first = np.flatnonzero(np.isinf(bar))
        if len(first) and len(x) > k:  # k rows besides the query itself
            bar = bar.copy()
            bar[first] = np.partition(near[first], k, 1)[:, k] + (qq + error)[first]
        row, at = np.divmod(np.flatnonzero(~(near > (bar - qq + error)[:, None])), len(x))
    other = own[at] != qid[row]
    row, at = row[other], at[other]
    d = np.empty(len(at))
    for s in range(0, len(at), PAIRS):
        part = slice(s, s + PAIRS)
        d[part] = np.sqrt(((x[at[part]] - q[row[part]]) ** 2).sum(1))
    return leading(row, own[at], d, k)


def leading(row: np.ndarray, vid: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query's rows, each once."""
    order = np.lexsort((vid, d, row))
    row, vid, d = row[order], vid[order], d[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (vid[1:] != vid[:-1])  # the same row from several tables
    row, vid, d = row[new], vid[new], d[new]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], vid[top], d[top]


def in_buckets(x: np.ndarray, own: np.ndarray, bucket: np.ndarray, q: np.ndarray, qid: np.ndarray, query: np.ndarray, probe: np.ndarray, k: int):
    """`closest` of each query among the rows of its buckets; probe: buckets visited by the queries in rows `query` of q."""
    order = np.argsort(bucket, kind="stable")
    x, own = x[order], own[order]
    keys, start = np.unique(bucket[order], return_index=True)
    end = np.append(start[1:], len(x))
    at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
    there = keys[at] == probe
    at, query = at[there], query[there]
    order = np.lexsort((query, at))
    at, query = at[order], query[order]
    visited, first = np.unique(at, return_index=True)
    last = np.append(first[1:], len(at))
    bar, found = np.full(len(q), np.inf), [NOTHING]
    # the largest buckets first: they bring the queries' bars down
    for i in np.argsort(start[visited] - end[visited], kind="stable"):
        lo, hi, own_queries = start[visited[i]], end[visited[i]], query[first[i] : last[i]]
        for s in range(lo, hi, ROWS):
            part = slice(s, min(s + ROWS, hi))
            for f in range(0, len(own_queries), QUERIES):
                rows = own_queries[f : f + QUERIES]
                row, vid, d = closest(x[part], own[part], q[rows], qid[rows], k, bar[rows])
                kth = np.flatnonzero(np.bincount(row, minlength=len(rows)) == k)
                far = d[np.searchsorted(row, kth, "right") - 1] ** 2
                bar[rows[kth]] = np.minimum(bar[rows[kth]], far)
                found.append((rows[row], vid, d))
    return leading(*map(np.concatenate, zip(*found, strict=True)), k)


def _rerank(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [NOTHING]
        if left.num_rows and right.num_rows:
            v, asked, probes = (t[c].combine_chunks() for t, c in ((left, "v"), (right, "v"), (right, "buckets")))
            dims, lens = v.value_lengths().to_numpy(), asked.value_lengths().to_numpy()
            for dim in np.intersect1d(dims, lens):
                mine, rows = np.flatnonzero(dims == dim), np.flatnonzero(lens == dim)
                x, q = (matrix(c.take(pa.array(i)), np.float64) for c, i in ((v, mine), (asked, rows)))
                visits, qid = probes.take(pa.array(rows)), ids(right["query_id"])[rows]
                query = np.repeat(np.arange(len(rows)), visits.value_lengths().to_numpy())
                row, vid, d = in_buckets(x, ids(left["id"])[mine], ids(left["bucket"])[mine], q, qid, query, visits.flatten().to_numpy(), k)
                found.append((qid[row], vid, d))
        return as_table(found)

    return run


def _scan(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [NOTHING]
        if left.num_rows and right.num_rows:
            x, own, q, qid = matrix(left["v"], np.float64), ids(left["id"]), matrix(right["v"], np.float64), ids(right["id"])
            one = np.zeros(len(x), np.int64)  # all rows are one bucket
            row, vid, d = in_buckets(x, own, one, q, qid, np.arange(len(q)), np.zeros(len(q), np.int64), k)
            found.append((qid[row], vid, d))
        return as_table(found)

    return run


def as_table(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def scanned(rows: DataFrame, queries: DataFrame, n_queries: int, k: int, block: int = 8192, queries_per_block: int = 1024) -> DataFrame:
    """The k nearest rows(id, v, dim) of each of queries(id, v, dim) by a grid of blocks of both."""
    blocks, qblocks = max(1, -(-rows.count() // block)), -(-n_queries // queries_per_block)
    x = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    q = queries.withColumn("q", F.pmod(F.xxhash64(F.col("id") + 1), F.lit(qblocks)).cast("int"))
    q = q.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "b", "q"]
    part = x.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(_scan(k), "query_id long, vec_id long, score double")
    return top_k(part, k, F.col("score"), F.col("vec_id"))


def nearest(
    vectors: DataFrame, k: int, every: int, tables: int = 3, hashes: int = 4, width: float = 1.0,
    success: float = 0.97, sample: int = 4096, bucket_rows: int = 4096, groups: int | None = None, seed: int = 7, far: float = 1.2,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of vectors(id, v array<double> or array<float>) whose id is divisible by `every`."""
    spark = vectors.sparkSession
    kind = vectors.schema["v"].dataType.simpleString()
    rows = vectors.where(F.col("id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    rows = one_row_per_id(rows, "id", "v").withColumn("dim", F.size("v"))
    cores = spark.sparkContext.defaultParallelism
    queries = cut(rows.where(F.col("id") % every == 0).repartition(2 * cores, "id"))
    copies = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")  # numbers sort faster than vectors
    kept = cut(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1))
    fit = kept.where("copy = 1").orderBy(F.xxhash64("id"), "id").limit(sample).select("dim", "v").toPandas()
    radius = {int(d): fit_radius(np.array(g["v"].tolist(), np.float64), k) for d, g in fit.groupby("dim")}
    kept = kept.drop("copy")
    share = 1 - (1 - success) ** (1 / tables)
    keyed = lambda whole, schema: kept.mapInArrow(_keyed(radius, seed, tables, hashes, width, whole), schema)
    slices = F.ceil(F.count(F.lit(1)) / F.lit(bucket_rows)).cast("int")
    sizes = keyed(False, "buckets array<long>").select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(slices.alias("slices"))
    large = checked_broadcast(cut(sizes.where("slices > 1")))
    # a group holds rows of several buckets, each of which finds k rows for every query that visits it: few groups, of bounded size
    groups = groups or max(8 * cores, -(-tables * kept.count() // (16 * bucket_rows)))
    group = lambda of: F.pmod(F.pmod(F.xxhash64("bucket"), F.lit(groups)) + of, F.lit(groups)).alias("g")
    of = F.coalesce("slices", F.lit(1))
    index = keyed(True, f"id long, v {kind}, buckets array<long>").select("id", "v", F.explode("buckets").alias("bucket"))
    index = index.join(large, "bucket", "left").select(group(F.pmod(F.xxhash64("id"), of)), "bucket", "id", "v").repartition(groups, "g")
    probes = queries.mapInArrow(_probe(radius, seed, tables, hashes, width, share), "bucket long, query_id long")
    probes = probes.join(large, "bucket", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), of - 1)))
    probes = probes.select(group(F.col("slice")), "bucket", "query_id").repartition(groups, "g")
    probes = probes.groupBy("g", "query_id").agg(F.collect_set("bucket").alias("buckets"))
    asked = checked_broadcast(queries.select(F.col("id").alias("query_id"), "v"))
    probes = probes.join(asked, "query_id").select("g", "query_id", "buckets", "v")
    part = index.groupBy("g").cogroup(probes.groupBy("g")).applyInArrow(_rerank(k), "query_id long, vec_id long, score double")
    part = part.repartition("query_id").dropDuplicates(["query_id", "vec_id"])  # dealt once for both steps
    found = top_k(part, k, F.col("score"), F.col("vec_id")).select("query_id", "rank", "vec_id", "score")
    found = cut(found)
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    r = F.lit(1.0)
    for dim, value in radius.items():
        r = F.when(F.col("dim") == dim, value).otherwise(r)
    short = cut(queries.join(full, "id", "left").where(F.col("kth").isNull() | (F.col("kth") > far * r)).select("id", "v", "dim"))
    n = short.count()
    if not n:
        return found
    whole = scanned(kept, short, n, k).select("query_id", "rank", "vec_id", "score")
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(whole)


def op4_lsh_search(spark, sf_dir: str) -> DataFrame:
    from sigweave.session import table

    e = table(spark, sf_dir, "embeddings")
    return nearest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k=10, every=100)
