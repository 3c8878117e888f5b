"""Exact duplicates by an extendible-hash index on shared files.

Texts are hashed to 64-bit keys. The leading bits of a key name its owner: a task that holds one range of keys and its
part of the directory. There the next bits lead to a bucket; a bucket with more than `ROOM` keys splits by its next bit,
and the owner's directory doubles when the bucket was as deep as the directory. Equal keys of different texts cannot be
split: they are chained, and a text is only taken for another one when their bytes are equal.

Three steps, each a table in the shared folder:

* windows: tasks read their documents once and put equal texts of a window together (bytes compared), so that a text that
  makes up a third of all rows leaves a task as one row. A window row has the text, its key and the ids of its rows.
* index: window rows without ids go to their owners as a stream. An owner keeps its distinct texts (owners are as many as
  the measured bytes need) and writes bucket pages (bucket, depth, place in the chain, key, text, kept id, size) and, for every
  window row, which id stays and how large the group is.
* verdicts: window rows join theirs by their unique number, so no hot key exists, and the ids come apart again.

`build` takes an earlier index as a start: owners load their pages first, then the new documents.

Defined results: null texts are empty texts; of equal texts the row with the largest id stays, null ids come last, and of
rows that repeat the largest id exactly one stays (keep_id is null if no row of the group has an id); every row counts in
group_size; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sigweave.llm.textbytes import text_bytes
from sigweave.session import scratch

ROOM, DEEPEST = 64, 24
HELD_BYTES, HELD_IDS, OWNER_BYTES, OWNER_ROWS = 32 << 20, 1_000_000, 16 << 20, 100_000
WINDOW = "entry long, key long, text_sha256 string, text binary, ids array<long>, keep_id long, n long, size long"
PAGE = "kind string, entry long, keep_id long, group_size long, here boolean, bucket long, depth int, link int, key long, text_sha256 string, text binary"


def digest_key(digest: bytes) -> int:
    """The first eight bytes of a digest, as a signed number."""
    return int.from_bytes(digest[:8], "big", signed=True)


class Directory:
    """Extendible hashing of one range of 64-bit keys: the keys that agree in their `taken` leading bits."""

    def __init__(self, taken: int, room: int = ROOM, deepest: int = DEEPEST):
        self.taken, self.room, self.deepest, self.depth = taken, room, deepest, 0
        self.slots: list[dict] = [{"depth": 0, "chains": {}}]
        self.texts: list[bytes] = []

    def _slot(self, key: int) -> int:
        return (key % 2**64 << self.taken) % 2**64 >> (64 - self.depth) if self.depth else 0

    def place(self, key: int, text: bytes) -> int:
        """Number of the text; one that is not there yet is put at the end of its key's chain."""
        bucket = self.slots[self._slot(key)]
        chain = bucket["chains"].setdefault(key, [])
        for number in chain:
            if self.texts[number] == text:
                return number
        chain.append(len(self.texts))
        self.texts.append(text)
        while len(bucket["chains"]) > self.room and bucket["depth"] < self.deepest:
            self._split(bucket)
            bucket = self.slots[self._slot(key)]
        return len(self.texts) - 1

    def _split(self, bucket: dict) -> None:
        if bucket["depth"] == self.depth:
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.depth += 1
        depth = bucket["depth"] + 1
        halves = [{"depth": depth, "chains": {}} for _ in (0, 1)]
        for key, chain in bucket["chains"].items():
            halves[(key % 2**64) >> (64 - self.taken - depth) & 1]["chains"][key] = chain
        span = 1 << (self.depth - depth)
        first = next(i for i in range(self._slot(next(iter(bucket["chains"]))), -1, -1) if i == 0 or self.slots[i - 1] is not bucket)
        self.slots[first : first + 2 * span] = [halves[0]] * span + [halves[1]] * span

    def pages(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(bucket, depth, link, key, number) of every text; a bucket is named by its leading bits after the range's."""
        at = 0
        while at < len(self.slots):
            b = self.slots[at]
            step = 1 << (self.depth - b["depth"])
            for key, chain in b["chains"].items():
                for link, number in enumerate(chain):
                    yield at // step, b["depth"], link, key, number
            at += step


def _windows(key_of: Callable[[bytes], int]):
    def run(batches):
        task, made, held, size, rows = TaskContext.get().partitionId() << 33, 0, {}, 0, 0

        def out():
            nonlocal made, size, rows
            texts = list(held)
            digests = [hashlib.sha256(t) for t in texts]
            ids = list(held.values())
            known = [[i for i in x if i is not None] for x in ids]
            arrays = [
                pa.array(range(task + made, task + made + len(texts)), pa.int64()),
                pa.array([key_of(d.digest()) for d in digests], pa.int64()),
                pa.array([d.hexdigest() for d in digests], pa.string()),
                pa.array(texts, pa.binary()),
                pa.array(ids, pa.list_(pa.int64())),
                pa.array([max(x) if x else None for x in known], pa.int64()),
                pa.array(list(map(len, ids)), pa.int64()),
                pa.array(list(map(len, texts)), pa.int64()),
            ]
            made += len(texts)
            held.clear()
            size = rows = 0
            return pa.RecordBatch.from_arrays(arrays, ["entry", "key", "text_sha256", "text", "ids", "keep_id", "n", "size"])

        for b in batches:
            for i, view in zip(b["doc_id"].to_pylist(), text_bytes(b["text"]), strict=True):
                text = view.tobytes()
                if text in held:
                    held[text].append(i)
                else:
                    held[text] = [i]
                    size += len(text)
                rows += 1
                if size > HELD_BYTES or rows > HELD_IDS:
                    yield out()
        if held:
            yield out()

    return run


def _own(taken: int, room: int):
    """One owner: pages of an earlier index and window rows in any order, pages and verdicts out at the end."""

    def run(batches):
        tree, keep, size, sha, first = Directory(taken, room), [], [], [], []
        entries, numbers = [], []
        for b in batches:
            cols = [b[c].to_pylist() for c in ("entry", "key", "text_sha256", "text", "keep_id", "n")]
            for entry, key, digest, text, best, n in zip(*cols, strict=True):
                at = tree.place(key, text)
                if at == len(keep):
                    keep.append(None)
                    size.append(0)
                    sha.append(digest)
                    first.append(0)
                # the row that stays: with the largest id, of equal ones that of the earlier index, then of the first window row
                rank = -1 if entry is None else entry
                better = best is not None and (keep[at] is None or best > keep[at])
                if not size[at] or better or (best == keep[at] and rank < first[at]):
                    keep[at], first[at] = best, rank
                size[at] += n
                if entry is not None:
                    entries.append(entry)
                    numbers.append(at)
        for lo in range(0, len(entries), 10_000):
            e, at = entries[lo : lo + 10_000], numbers[lo : lo + 10_000]
            yield _rows(
                kind=["verdict"] * len(e), entry=e, keep_id=[keep[i] for i in at], group_size=[size[i] for i in at],
                here=[first[i] == x for i, x in zip(at, e, strict=True)],
            )
        held, held_bytes = [], 0
        for page in tree.pages():
            held.append(page)
            held_bytes += len(tree.texts[page[4]])
            if held_bytes > HELD_BYTES // 4 or len(held) >= 10_000:
                yield _page_rows(tree, held, keep, size, sha)
                held, held_bytes = [], 0
        if held:
            yield _page_rows(tree, held, keep, size, sha)

    return run


_FIELDS = [("kind", pa.string()), ("entry", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("here", pa.bool_()), ("bucket", pa.int64()),
           ("depth", pa.int32()), ("link", pa.int32()), ("key", pa.int64()), ("text_sha256", pa.string()), ("text", pa.binary())]


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f], t) if f in columns else pa.nulls(n, t) for f, t in _FIELDS], [f for f, _ in _FIELDS])


def _page_rows(tree: Directory, pages: list, keep: list, size: list, sha: list) -> pa.RecordBatch:
    bucket, depth, link, key, at = (list(x) for x in zip(*pages, strict=True))
    return _rows(
        kind=["page"] * len(at), keep_id=[keep[i] for i in at], group_size=[size[i] for i in at], bucket=bucket, depth=depth, link=link,
        key=key, text_sha256=[sha[i] for i in at], text=[tree.texts[i] for i in at],
    )


class Index:
    """An index below a folder: `pages` are its bucket pages, `verdicts` say for each document of its last build what stays."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def pages(self) -> DataFrame:
        """(bucket, depth, link, key, text_sha256, text, keep_id, group_size): one row per distinct text."""
        rows = self.spark.read.schema(PAGE).parquet(f"{self.path}/index").where("kind = 'page'")
        return rows.select("bucket", "depth", "link", "key", "text_sha256", "text", "keep_id", "group_size")

    def verdicts(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256): one row per document."""
        said = self.spark.read.schema(PAGE).parquet(f"{self.path}/index").where("kind = 'verdict'").select("entry", F.col("keep_id").alias("keep"), "group_size", "here")
        rows = self.spark.read.schema(WINDOW).parquet(f"{self.path}/windows").select("entry", "text_sha256", "ids")
        at = F.when(F.col("keep").isNull(), F.lit(1)).otherwise(F.array_position("ids", F.col("keep")))
        j = rows.join(said, "entry").select("text_sha256", F.col("keep").alias("keep_id"), "group_size", "here", at.alias("at"), F.posexplode("ids").alias("i", "doc_id"))
        return j.select("doc_id", "keep_id", "group_size", (F.col("here") & (F.col("i") + 1 == F.col("at"))).alias("kept"), "text_sha256")


def build(docs: DataFrame, path: str, base: Index | None = None, key_of: Callable[[bytes], int] = digest_key, room: int = ROOM) -> Index:
    """The index of docs(doc_id, text) below the new folder `path`, on top of an earlier one if given."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(_windows(key_of), WINDOW).write.option("compression", "zstd").parquet(f"{path}/windows")
    fields = ["entry", "key", "text_sha256", "text", "keep_id", "n"]
    made = spark.read.schema(WINDOW).parquet(f"{path}/windows")
    todo, sizes = made.select(*fields), made.select("size")
    if base is not None:
        old = base.pages()
        todo = old.select(F.lit(None).cast("long").alias("entry"), "key", "text_sha256", "text", "keep_id", F.col("group_size").alias("n")).unionByName(todo)
        sizes = old.select(F.octet_length("text").cast("long").alias("size")).unionByName(sizes)
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_BYTES), -(-n // OWNER_ROWS))
    taken = int(owners - 1).bit_length()
    owner = F.shiftrightunsigned("key", 64 - taken).cast("int") if taken else F.lit(0)
    owned = todo.withColumn("owner", owner).repartitionById(1 << taken, "owner").drop("owner")
    owned.mapInArrow(_own(taken, room), PAGE).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/index")
    return Index(spark, path)


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from sigweave.session import table

    return build(table(spark, sf_dir, "documents"), scratch(spark, "exact")).verdicts()


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
