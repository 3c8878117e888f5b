"""Packing of tokenised documents into fixed-length sequences by minimum bin slack.

A document's ids (with the end id) are cut into pieces of `capacity` ids; these fill sequences of their own. What is left
of a document, 1 to capacity - 1 ids, is packed: the longest remaining length opens a sequence, and a subset-sum dynamic
programme over the multiset of remaining lengths (one bit per reachable sum, kept per step) finds the filling closest to
the capacity, whose counts are read by going back through the steps. A filling is repeated as often as the counts allow,
so the plan depends on the histogram of at most capacity - 1 lengths only, however many documents there are.

Only this histogram reaches the driver. Pieces get their place in the plan by their rank among pieces of equal length;
ranks are counted in slices of bounded size, so one very common length is dealt over many tasks. Tokens are made once,
in one narrow stage; a document's ids never leave their task (`pieces` holds starts, lengths and checksums; `sequences`
gives the ids themselves for training).

Defined results: a null or empty text is one piece with the end id alone; repeated rows are packed each; a null id stays
null; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sigweave.llm.pretokens import encode_in_groups
from sigweave.session import cut

MEMO = 500_000
#: rows of a slice in which ranks are counted
SLICE = 10_000


class WordTokenizer:
    """Ids of whole texts by a tokenizers file, each pre-token encoded once and kept in a bounded memo.

    A text that holds one of the file's added tokens is encoded as a whole, since those are matched before the split.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        new = list(words)
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.memo[w] = np.array(e.ids, "<u4").tobytes()

    def _whole(self, text: str) -> bytes | None:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return None

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        return encode_in_groups(texts, self.memo, MEMO, self.learn, self._whole)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of every piece of docs(doc_id, text)."""
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def run(batches):
        t = word_tokenizer(path)
        for b in batches:
            doc, start, length, crc, total, ids = [], [], [], [], [], []
            encoded = t.encode_all(x.as_py() or "" for x in b["text"])
            for d, made in zip(b["doc_id"], encoded, strict=True):
                blob = made + end
                for at in range(0, len(blob), step):
                    part = blob[at : at + step]
                    doc.append(d.as_py())
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(blob) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and counts, within `counts`, whose sum is the largest that is not over `room`."""
    reach, steps, mask, goal = 1, [], (1 << room + 1) - 1, 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left and not reach & goal:
            use = min(times, left)  # 1, 2, 4, ... copies at once: every count can be put together
            steps.append((length, use, reach))
            reach |= reach << length * use & mask
            left, times = left - use, times * 2
        if reach & goal:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, use, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + use
            total -= length * use
    return taken


def fill_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, per sequence, first sequence, offset) of every part of every filling."""
    left, used, plan, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while left:
        longest = max(left)
        own = left[longest] - 1
        rest = {k: v for k, v in left.items() if k != longest} | ({longest: own} if own else {})
        filling = best_filling(rest, capacity - longest)
        filling[longest] = filling.get(longest, 0) + 1
        times = min(left[k] // n for k, n in filling.items())
        offset = 0
        for k, n in sorted(filling.items(), reverse=True):
            plan.append((k, used[k], used[k] + times * n, n, sequence, offset))
            offset += k * n
            used[k] += times * n
            left[k] -= times * n
            if not left[k]:
                del left[k]
        sequence += times
    return plan


def place(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces with `sequence_id` and `offset`; `parts` must be stored rows (they are read several times)."""
    spark = parts.sparkSession
    small = parts.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in small.groupBy("length").count().collect()}  # under `capacity` rows
    plan = fill_plan(histogram, capacity)
    packed = max((seq + (last - first) // n for _, first, last, n, seq, _ in plan), default=0)
    steps = spark.createDataFrame(plan or [(0, 0, 0, 1, 0, 0)], "length long, first long, last long, n long, seq long, off long")
    slices = max(1, -(-sum(histogram.values()) // SLICE))
    s = small.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slices)))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = s.groupBy("length", "slice").count()
    sizes = sizes.select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32")
    s = s.withColumn("r", F.row_number().over(inside) - 1).join(sizes, ["length", "slice"]).withColumn("r", F.col("r") + F.col("base"))
    p = F.broadcast(steps.withColumnRenamed("length", "l"))  # at most a few rows per filling, fillings bounded by the lengths
    s = s.join(p, (F.col("length") == F.col("l")) & (F.col("r") >= F.col("first")) & (F.col("r") < F.col("last")))
    at = F.col("r") - F.col("first")
    s = s.withColumns(
        {"sequence_id": F.col("seq") + F.floor(at / F.col("n")), "offset": F.col("off") + (at % F.col("n")) * F.col("length")}
    ).select(*parts.columns, "sequence_id", "offset")
    whole = parts.where(F.col("length") == capacity).withColumns(
        {"sequence_id": F.lit(packed) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    return whole.unionByName(s)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of docs(doc_id, text)."""
    return place(cut(pieces(docs, path, capacity, end_id)), capacity)


def sequences(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; the pieces of one sequence hold `capacity` ids at most."""
    placed = place(cut(pieces(docs, path, capacity, end_id, with_ids=True)), capacity)
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda x: x["ids"])).alias("ids"))


def op7_pack(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    from sigweave.session import table

    return pack(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
