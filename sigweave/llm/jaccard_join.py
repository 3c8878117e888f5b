"""Near-duplicate classes by a parity-sketch join on word shingles, exact for the stated similarity.

Two sets with intersection / union >= t differ in at most (1 - t) / (1 + t) * (|A| + |B|) elements. Shingles are XOR-hashed
into a sketch of G words (one word per shingle, chosen by hash); each differing element changes at most one word, so the
number of differing words is a lower bound of the symmetric difference. Sizes fall into bands whose ends grow by 1 / t;
a level joins a band with the next one and with itself. With at most D differences on a level and G > D words, two linked
sets agree in a word (pigeonhole): sketch words are the join keys. Empty words are no keys, unless a set has so many
of them that its agreeing words might all be empty.

Keys travel in blobs (a row per block of documents and bucket), so a shuffle moves about 8 bytes per key. Members of a
key form a run; equal runs are one run. In a run a second parity sketch (1 bit per shingle, as many bits as shingles
at least) bounds the difference again, with whole rows of Hamming distances at a time. What passes is verified on whole sets. A run never
emits all its pairs: members that are in one class already are skipped, and while more than `CLOSED` pairs per member
are open, each member proposes only those with the smallest ids outside its class (the same ones in most of its runs), one
in the first round and `GROWTH` times as many in each further one; rounds go on until no run is open, so no link between
classes is lost. Runs over `BLOCK` members are split into pairs of blocks.

Equal sets are one node (its smallest doc_id). Of equal sets in a block of documents only the smallest id sends keys.
Components are found on links in shared tables; no list of links or ids reaches the driver.

Defined results: null or blank texts have no shingles and stay alone (component_id is their own id); texts of fewer words
than a shingle are one shingle of all words; rows with a null doc_id are linked with nothing and have a null
component; rows that repeat an id are one node with the links of each of them; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sigweave.llm.links import IdFilter, buckets_of, components, few_tasks
from sigweave.llm.shingles import mixed, shingles
from sigweave.llm.textbytes import text_bytes
from sigweave.session import cut, release

BITS, BLOCK, DOCS, SLICE = 1024, 2000, 2000, 500
CLOSED, GROWTH = 2, 8
#: bytes of a key that travel; the bucket, a hash of the whole key, tells keys apart as well. Keys that meet by chance lose no link,
#: their sets are in one run and are compared like others
KEY_BYTES = 6
#: open runs that are broadcast
RUNS = 500_000


def size_bands(percent: int, upto: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands: a set's partners lie in its own band and its neighbours."""
    edges = [1]
    while edges[-1] < upto:
        edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent + 1))
    return np.array(edges)


def levels_of(size: int, edges: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
    """(level, D, G) of the two levels a set takes part in."""
    band, out = int(np.searchsorted(edges, size, "right")) - 1, []
    for level in (band, band + 1):
        if level == 0:
            continue
        low, high = int(edges[level]) - 1, int(edges[level + 1]) - 1
        d = (100 - percent) * (low + min(high, low * 100 // percent)) // (100 + percent)
        out.append((level, d, d + 3 + (d + 1) // 16))
    return out


def sketch_keys(s: np.ndarray, level: int, d: int, g: int) -> np.ndarray:
    """Join keys of a set on a level: its non-empty sketch words, and the empty ones where they could be all that agrees."""
    salt = np.uint64(level * 7919 + 1)
    word = (mixed(s ^ salt) % np.uint64(g)).astype(np.int64)
    order = np.argsort(word, kind="stable")
    at = word[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    value, name = np.bitwise_xor.reduceat(mixed(s * np.uint64(0x9E3779B97F4A7C15) + salt)[order], first), at[first]
    if g - d - (g - len(first)) < 1:
        empty = np.setdiff1d(np.arange(g), name)
        value, name = np.r_[value, np.zeros(len(empty), np.uint64)], np.r_[name, empty]
    return mixed(value ^ mixed(name.astype(np.uint64) + (salt << np.uint64(32))))


def parity_bits(s: np.ndarray) -> bytes:
    """A bit per shingle, XORed: `BITS` bits, doubled until there are as many as shingles. A longer sketch folds to a shorter one."""
    size = max(BITS, 1 << max(0, len(s) - 1).bit_length())
    at = (mixed(s ^ np.uint64(0xA5A5A5A5)) % np.uint64(size)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all folded to the shortest one's length (bits that meet are XORed)."""
    n = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, n), 0) for x in sketches])


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit keys of a set, as signed numbers."""
    if not len(s):
        return 0, 0
    a = np.add.reduce(mixed(s ^ np.uint64(0x1234567)))
    b = np.bitwise_xor.reduce(mixed(s + np.uint64(0x9E3779B97F4A7C15)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, k1, k2, bits) of every row."""

    def run(batches):
        for b in batches:
            n, k1, k2, bits = [], [], [], []
            for t in text_bytes(b["text"]):
                s = shingles(t)
                x, y = set_keys(s)
                n.append(len(s))
                k1.append(x)
                k2.append(y)
                bits.append(parity_bits(s))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["row"], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.binary())],
                ["doc_id", "row", "n_shingles", "k1", "k2", "bits"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, n_shingles long, k1 long, k2 long, bits binary")


def packed_keys(keys: np.ndarray) -> bytes:
    """The low KEY_BYTES bytes of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked_keys(b: bytes) -> np.ndarray:
    whole = np.zeros((len(b) // KEY_BYTES, 8), np.uint8)
    whole[:, :KEY_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, KEY_BYTES)
    return whole.view("<u8").ravel().astype(np.uint64)


def packed_ids(ids: np.ndarray) -> bytes:
    """The smallest id, then what the others have over it, in as few bytes each as the largest of these needs.

    With many buckets most keys of a document are in a bucket of their own, and its id goes with each of them.
    """
    over = ids.astype(np.uint64) - np.uint64(ids.min().astype(np.uint64))
    return ids.min().astype("<i8").tobytes() + over.astype(np.min_scalar_type(over.max()).newbyteorder("<")).tobytes()


def unpacked_ids(b: bytes, n: int) -> np.ndarray:
    over = np.frombuffer(b, f"<u{(len(b) - 8) // n}", offset=8).astype(np.uint64)
    return (over + np.frombuffer(b, "<u8", 1)).astype(np.int64)


def _keys(percent: int, buckets: int):
    edges = size_bands(percent)

    def block(docs: list[int], sets: list[int], found: list[list[np.ndarray]]):
        keys = np.concatenate([k for x in found for k in x])
        own = np.repeat(np.arange(len(docs)), [sum(map(len, x)) for x in found]).astype(np.uint16)
        bucket = buckets_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        rows = {"bucket": [], "keys": [], "own": [], "docs": [], "sets": []}
        for n, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)):
            if lo == hi:
                continue
            at = order[lo:hi]
            used, index = np.unique(own[at], return_inverse=True)
            rows["bucket"].append(n)
            rows["keys"].append(packed_keys(keys[at]))
            rows["own"].append(index.astype(np.uint16).tobytes())
            rows["docs"].append(packed_ids(np.array(docs, np.int64)[used]))
            rows["sets"].append(np.array(sets, np.int64)[used].tobytes())
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))

    def run(batches):
        at: dict[tuple, int] = {}
        docs, sets, found = [], [], []
        for b in batches:
            for doc, t in zip(b["doc_id"].to_pylist(), text_bytes(b["text"]), strict=True):
                s = shingles(t)
                if doc is None or not len(s):
                    continue
                k = (*set_keys(s), len(s))
                if k in at:  # an equal set of this block: its keys are there already
                    docs[at[k]] = min(docs[at[k]], doc)
                    continue
                at[k] = len(docs)
                docs.append(doc)
                sets.append(k[0])
                found.append([sketch_keys(s, *x) for x in levels_of(len(s), edges, percent)])
                if len(docs) >= DOCS or sum(map(len, found[-1])) > 1 << 20:
                    yield block(docs, sets, found)
                    at, docs, sets, found = {}, [], [], []
        if docs:
            yield block(docs, sets, found)

    return run


def _runs(t: pa.Table) -> pa.Table:
    """(run, doc_id): members of keys that several sets have; the run's id is a hash of its members."""
    keys, docs, sets = [], [], []
    for k, o, d, s in zip(t["keys"], t["own"], t["docs"], t["sets"], strict=True):
        own = np.frombuffer(o.as_py(), np.uint16)
        keys.append(unpacked_keys(k.as_py()))
        docs.append(unpacked_ids(d.as_py(), int(own.max()) + 1)[own])
        sets.append(np.frombuffer(s.as_py(), np.int64)[own])
    keys, docs, sets = np.concatenate(keys), np.concatenate(docs), np.concatenate(sets)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = np.r_[False, keys[1:] == keys[:-1]]
    shared = same | np.r_[same[1:], False]  # keys that occur once are gone from here on
    keys, docs, sets = keys[shared], docs[order][shared], sets[order][shared]
    order = np.lexsort((docs, sets, keys))
    keys, docs, sets = keys[order], docs[order], sets[order]
    first = np.r_[True, (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])][: len(keys)]  # the smallest id of equal sets
    keys, docs = keys[first], docs[first]
    empty = pa.table({"run": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64())})
    if not len(keys):
        return empty
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    name = np.add.reduceat(mixed(docs.astype(np.uint64)), start)
    _, pick = np.unique(name, return_index=True)
    pick = pick[size[pick] > 1]
    n = size[pick]
    if not len(n):
        return empty
    at = np.repeat(start[pick] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return pa.table({"run": np.repeat(name[pick].astype(np.int64), n), "doc_id": docs[at]})


def _propose(percent: int, turn: int):
    """(run, a, b): pairs of a run to be verified; a row with null a says that the run stays open."""

    def run(t: pa.Table) -> pa.Table:
        doc, comp, n = (t[c].to_numpy() for c in ("doc_id", "component", "n_shingles"))
        name = t["run"][0].as_py()
        out = {"run": [], "a": [], "b": []}
        order = np.lexsort((doc, n))
        doc, comp, n = doc[order], comp[order], n[order]
        bits = folded(t["bits"].combine_chunks().take(pa.array(order)).to_pylist())
        last = np.searchsorted(n * percent, 100 * n, "right")  # partners are at most 100 / percent as large
        pairs = []
        if comp.min() != comp.max():
            for i in range(len(doc)):
                j = np.arange(i + 1, last[i])
                j = j[comp[j] != comp[i]]
                if not len(j):
                    continue
                h = np.bitwise_count(bits[i] ^ bits[j]).sum(1)
                ok = h * (100 + percent) <= (100 - percent) * (n[i] + n[j])
                if ok.any():
                    pairs.append(np.stack([np.full(ok.sum(), i), j[ok]], 1))
        if pairs:
            pairs = np.concatenate(pairs)
            if len(pairs) > CLOSED * len(doc):
                both = np.concatenate([pairs, pairs[:, ::-1]])
                by = np.lexsort((doc[both[:, 1]], both[:, 0]))
                first = np.flatnonzero(np.r_[True, np.diff(both[by, 0]) != 0])
                count = np.diff(np.r_[first, len(by)])
                nth = np.arange(len(by)) - np.repeat(first, count)
                if count.max() > GROWTH**turn:
                    pairs = np.unique(np.sort(both[by[nth < GROWTH**turn]], 1), axis=0)
                    out = {"run": [name], "a": [None], "b": [None]}
            pairs = np.sort(doc[pairs], 1)
            out = {k: out[k] + v for k, v in {"run": [name] * len(pairs), "a": pairs[:, 0].tolist(), "b": pairs[:, 1].tolist()}.items()}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, s): shingles of the documents named in ids(doc_id), found in a narrow pass; a few others may come along."""
    few = IdFilter(ids)

    def run(batches):
        for b in batches:
            keep = few.passes(b["at"].to_numpy())
            if keep.any():
                b = b.filter(pa.array(keep))
                found = [shingles(t).tobytes() for t in text_bytes(b["text"])]
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, pa.binary())], ["doc_id", "s"])

    return docs.where("doc_id is not null").withColumn("at", few.column("doc_id")).mapInArrow(run, "doc_id long, s binary")


def _verify(percent: int):
    def alike(p: np.ndarray, q: np.ndarray) -> bool:
        both = len(np.intersect1d(p, q, assume_unique=True))
        return 100 * both >= percent * (len(p) + len(q) - both) > 0

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict[int, list] = {}
        for d, s in zip(right["doc_id"].to_pylist(), right["s"], strict=True):
            sets.setdefault(d, []).append(np.frombuffer(s.as_py(), np.uint64))
        pairs = zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True)
        good = [(a, b) for a, b in pairs if any(alike(p, q) for p in sets[a] for q in sets[b])]
        return pa.table({"a": pa.array([a for a, _ in good], pa.int64()), "b": pa.array([b for _, b in good], pa.int64())})

    return run


def verified(docs: DataFrame, pairs: DataFrame, n_pairs: int, percent: int) -> DataFrame:
    """The pairs(a, b) whose whole sets are alike; `n_pairs` is their number.

    Pairs are dealt out by their first document (in slices of `SLICE` partners); a part gets the set of each document it
    needs once.
    """
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = few_tasks(pairs, n_pairs)
    ids = cut(few_tasks(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), n_pairs))
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE)).alias("slices"))
    part = F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("slices"))), F.lit(parts))
    p = few_tasks(pairs.join(slices, "a"), n_pairs).select(part.alias("part"), "a", "b")
    needs = p.select("part", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = whole_sets(docs, ids).join(needs, "doc_id").select(F.col("part").alias("to"), "doc_id", "s")
    return p.groupBy("part").cogroup(sets.groupBy("to")).applyInArrow(_verify(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, row) of every row of docs(doc_id, text); `row` is the text's xxhash64."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(profile(docs))
    classes = rows.where("doc_id is not null and n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("node"))
    blobs = docs.mapInArrow(_keys(percent, buckets), "bucket int, keys binary, own binary, docs binary, sets binary")
    members = blobs.groupBy("bucket").applyInArrow(_runs, "run long, doc_id long").distinct()
    sizes = members.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))
    members = members.join(sizes, "run").withColumn("own", own).withColumn("other", other)
    part = F.when(F.col("blocks") == 1, F.col("run")).otherwise(F.xxhash64("run", F.least("own", "other"), F.greatest("own", "other")))
    bits = rows.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "bits").distinct()
    # stored with what proposing needs, so that later rounds only pick their runs
    members = cut(members.select(part.alias("run"), "doc_id").distinct().join(bits, "doc_id"))
    release(spark)
    links, comps, turn, m, n_rows = None, None, 0, members, None
    while True:
        if comps is None:
            m = m.withColumn("component", F.col("doc_id"))
        else:
            m = m.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            m = m if n_rows is None else few_tasks(m, n_rows)
        proposed = m.groupBy("run").applyInArrow(_propose(percent, turn), "run long, a long, b long")
        proposed = cut(proposed if n_rows is None else few_tasks(proposed, n_rows))
        pairs = cut(proposed.where("a is not null").select("a", "b").distinct())
        n_pairs = pairs.count()
        release(spark)
        if n_pairs:
            found = few_tasks(verified(docs, pairs, n_pairs, percent), n_pairs)
            links = cut(found if links is None else links.unionByName(found))
            release(spark)
            comps = components(links)
        open_runs = proposed.where("a is null").select("run").distinct()
        n_open = proposed.where("a is null").count()
        if not n_open:
            break
        # a run is 8 bytes: up to RUNS of them are broadcast, more are joined by shuffle
        open_runs = cut(few_tasks(open_runs, n_open))
        m = cut(members.join(F.broadcast(open_runs) if n_open <= RUNS else open_runs, "run", "left_semi"))
        n_rows, turn = m.count(), turn + 1
        m = few_tasks(m, n_rows)
    if comps is not None:
        classes = classes.join(comps.withColumnRenamed("id", "node"), "node", "left")
        classes = classes.withColumn("node", F.coalesce("component", "node"))
    named = rows.select("doc_id", "row", "n_shingles", "k1", "k2").join(classes.select("k1", "k2", "n_shingles", "node"), ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), "row")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows of docs(doc_id, text, ...) with one row of each near-duplicate class: the smallest id's.

    Rows without words or without an id are in no class and stay.
    """
    found = cut(near_duplicates(docs, percent).where("component_id is not null and n_shingles > 0").select("doc_id", "component_id", "row"))
    release(docs.sparkSession)
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("x.doc_id", "x.row")
    others = found.select("doc_id", "row").distinct().join(first, ["doc_id", "row"], "left_anti").withColumn("drop", F.lit(True))
    key = F.xxhash64(F.col("text").cast("string"))
    words = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = docs.select(F.struct("*").alias("all"), F.col("doc_id").cast("long").alias("id"), key.alias("row"), words.alias("words"))
    others = others.withColumnRenamed("doc_id", "id")
    marked = marked.join(others, ["id", "row"], "left").where("drop is null")
    again = F.row_number().over(Window.partitionBy("id", "row").orderBy("id"))  # a row that is there several times
    marked = marked.withColumn("again", F.when(F.col("id").isNotNull() & F.col("words"), again)).where("again is null or again = 1")
    return marked.select("all.*")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from sigweave.session import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
