"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary's byte strings (hash and displace: a word's bucket names the
displacement that sends each vocabulary word to a slot of its own, without spare slots): a pre-token that is a
vocabulary entry is resolved by one probe and one comparison. The others are merged byte by byte: a heap holds the
ranks of neighbouring pairs over a linked list of parts, lowest rank first, leftmost first among equals.

Equal pre-tokens of a group of documents are resolved once, the new ones of the group together; a bounded memo per worker
keeps results between groups. Documents are
rows of one narrow stage without any exchange; very long texts are split at pre-token boundaries.

Defined results: a null text is empty (no ids); invalid ids raise KeyError in `decode`; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sigweave.llm.pretokens import encode_in_groups

MEMO = 500_000
GOLD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each byte string, one Horner step per byte over all words of a length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
    out = np.empty(len(words), np.uint64)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        h = np.full(len(rows), n + 1, np.uint64)
        for j in range(n):
            h = (h ^ flat[start[rows] + j]) * GOLD
            h ^= h >> np.uint64(29)
        out[rows] = h * MIX ^ (h >> np.uint64(32))
    return out


class PerfectHash:
    """Minimal perfect hash of a fixed list of byte strings; `find` gives each word's index, or -1."""

    def __init__(self, words: list[bytes]):
        self.n = n = len(words)
        self.buckets = max(1, n // 3)
        h = hash_words(words)
        if len(np.unique(h)) != n:
            raise ValueError("the words are not distinct")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot = np.full(n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=self.buckets))
        free = np.ones(n, bool)
        sizes = np.diff(ends, prepend=0)
        for k in np.argsort(-sizes, kind="stable"):
            own = order[ends[k] - sizes[k] : ends[k]]
            if not len(own):
                break
            if len(own) == 1:  # alone: its slot is taken as it is, kept as a negative number
                break
            base = 0
            while True:
                d = np.arange(base, base + 64)
                at = self._slot(h[own][None, :], d[:, None])
                good = free[at].all(1)
                good[good] = [len(set(x)) == len(own) for x in at[good].tolist()]
                if good.any():
                    first = int(np.argmax(good))
                    self.shift[k] = d[first]
                    self.slot[at[first]] = own
                    free[at[first]] = False
                    break
                base += 64
        alone = np.flatnonzero(sizes == 1)
        spots = np.flatnonzero(free)
        self.shift[alone] = -1 - spots
        self.slot[spots] = order[ends[alone] - 1]
        self.words = words

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ d.astype(np.uint64) * MIX) * GOLD
        return ((x ^ (x >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def find(self, words: list[bytes]) -> list[int]:
        if not words:
            return []
        h = hash_words(words)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        at = self.slot[np.where(d < 0, -1 - d, self._slot(h, d))].tolist()
        own = self.words
        return [i if own[i] == w else -1 for i, w in zip(at, words, strict=True)]


class Codec:
    """Encoder and decoder for a file of ranks (a base64 word and its rank in each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(w): int(r) for w, r in map(bytes.split, f)}
        self.word = {r: w for w, r in ranks.items()}
        self.rank = list(ranks.values())
        self.table = PerfectHash(list(ranks))
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.join = {
            ranks[w[:i]] << 32 | ranks[w[i:]]: r for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks
        }
        self.memo: dict[str, bytes] = {}
        self.size = np.zeros(max(self.word) + 1, np.int64)
        self.size[list(self.word)] = list(map(len, self.word.values()))
        by_id = [self.word.get(i, b"") for i in range(len(self.size))]
        self.flat, self.start = np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(self.size) - self.size

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: merges by rank with a heap over linked parts."""
        join, n = self.join.get, len(word)
        part = [self.byte[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := join(part[i] << 32 | part[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            # an entry is stale when its left part is gone or its pair has changed
            if part[i] < 0 or j >= n or join(part[i] << 32 | part[j]) != r:
                continue
            part[i], part[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := join(r << 32 | part[k])) is not None:
                    heappush(heap, x * n + i)
            if (k := before[i]) >= 0 and (x := join(part[k] << 32 | r)) is not None:
                heappush(heap, x * n + k)
        return [x for x in part if x >= 0]

    def learn(self, words: set[str]) -> None:
        """Adds the ids of pre-tokens to the memo: the perfect hash first, the heap for what it does not hold."""
        new = list(words)
        raw = [w.encode() for w in new]
        for w, b, i in zip(new, raw, self.table.find(raw), strict=True):
            ids = [self.rank[i]] if i >= 0 else self.merge(b)
            self.memo[w] = pack(f"<{len(ids)}I", *ids)

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return encode_in_groups(texts, self.memo, MEMO, self.learn, lambda t: None)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        """The words of the ids, gathered from one string of all words."""
        i = np.frombuffer(ids, "<u4")
        if len(i) and (i.max() >= len(self.size) or not self.size[i].all()):
            raise KeyError("an id is not in the vocabulary")
        n = self.size[i]
        return self.flat[np.repeat(self.start[i] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _digest(path: str):
    def run(batches):
        c = codec(path)
        for b in batches:
            n, enc, dec = [], [], []
            for ids in c.encode_all(t.as_py() or "" for t in b["text"]):
                n.append(len(ids) // 4)
                enc.append(hashlib.sha256(ids).hexdigest())
                dec.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_rows(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) with `ids`, the token ids of every whole text."""

    def run(batches):
        c = codec(path)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in c.encode_all(t.as_py() or "" for t in b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode_rows(rows: DataFrame, path: str) -> DataFrame:
    """rows(doc_id, ids) with `text`, the decoded bytes as a string (null ids: null)."""

    def run(batches):
        c = codec(path)
        for b in batches:
            out = [None if (x := i.as_py()) is None else c.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for i in b["ids"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op9_byte_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    from sigweave.session import table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    run = _digest(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
