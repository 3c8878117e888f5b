"""Removal of repeated strings of `length` bytes over all documents, exact to the byte.

Every window of `length` bytes has one anchor: its `gram`-byte substring with the smallest hash (the first of equals).
Equal windows have the same anchor at the same distance, so windows can be compared where their anchors meet:

1. Anchors of all texts are counted by hash. Those that occur more than once set bits in a filter of fixed size.
2. Texts are read again; for each anchor in the filter the stretch of its windows (at most 2 * length - gram bytes) goes to
   the anchor's bucket, equal stretches of a block of documents once, with all their places.
3. In a bucket, the stretches of anchors with several different stretches become one sequence of symbols: the bytes left
   of the anchor, the anchor, the bytes right of it, an end mark. Its suffix array is built by linear grouping
   (`gsaca.py`). Suffixes that agree in two symbols, neighbours in the array, are the candidates: a repeated window holds
   the anchor and at least half of the remaining bytes on one side. Their windows are compared as wholes.
4. Of equal windows the earliest start stays, every other start is a removed window; a text's removed windows are joined
   to it and its bytes cut out.

A bucket holds each stretch of a block once, so a passage shared by a third of all documents costs one stretch per block of
documents; its places are a few bytes each. Removed starts travel as ranges. Filter false positives cost work, not results.
Hashes of 64 bits stand for anchors, stretches and windows.

Defined results: a null text is empty; texts under `length` bytes stay whole; an order by (doc_id, start) decides which
string is earlier, null ids come last; rows that repeat an id are one document in that order, so equal rows get equal
results and both keep what neither has earlier; overlapping repeats inside a document count; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sigweave.llm.gsaca import suffix_array
from sigweave.llm.shingles import mixed, powers
from sigweave.llm.textbytes import text_bytes

CHUNK, DOCS, BYTES = 1 << 18, 2000, 8 << 20
LAST = (1 << 63) - 1
BYTE = np.random.default_rng(977).integers(0, 2**64, 256, np.uint64)
AT = np.uint64((1 << 20) - 1)


def prefix_sums(text: np.ndarray) -> np.ndarray:
    up, _ = powers(len(text) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[text] * up[: len(text)])])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) from the text's prefix sums; equal bytes have equal hashes anywhere."""
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def anchors(text: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, sums, place, hash, first, last) per chunk: anchors and the range of window starts that have them.

    Places and starts count from the chunk's offset.
    """
    for off in range(0, max(0, len(text) - length + 1), CHUNK):
        part = text[off : off + CHUNK + length - 1]
        sums = prefix_sums(part)
        n = len(part) - gram + 1
        _, down = powers(len(sums))
        h = mixed((sums[gram:] - sums[:n]) * down[:n])
        low = (h & ~AT) | np.arange(n, dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have * 2 <= width:
            low = np.minimum(low[: len(low) - have], low[have:])
            have *= 2
        if width > have:
            low = np.minimum(low[: len(low) - width + have], low[width - have :])
        place = (low & AT).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        place = place[first]
        yield off, sums, place, h[place], first, last


def _count(length: int, gram: int, bits: int, buckets: int):
    """Anchor hashes by bucket; one that occurs several times in a block is sent twice."""

    def block(found: list[np.ndarray]):
        keys = np.sort(np.concatenate(found))
        same = np.concatenate([[False], keys[1:] == keys[:-1]])
        third = np.concatenate([[False, False], keys[2:] == keys[:-2]])[: len(keys)]
        keys = keys[~(same & third)]
        bucket = (keys % np.uint64(bits)).astype(np.int64) * buckets // bits
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        starts = np.concatenate([[0], ends[:-1]])
        rows = [(n, keys[order[lo:hi]].tobytes()) for n, (lo, hi) in enumerate(zip(starts, ends, strict=True)) if hi > lo]
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.binary())], ["bucket", "keys"])

    def run(batches):
        found, size = [], 0
        for b in batches:
            for t in text_bytes(b["text"]):
                for _, _, _, h, _, _ in anchors(t, length, gram):
                    found.append(h)
                    size += len(h)
                if size > 1 << 19:
                    yield block(found)
                    found, size = [], 0
        if found:
            yield block(found)

    return run


def _repeated(bits: int):
    """(word, mask) of the filter's bits that repeated anchors of a bucket set."""

    def run(t: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.frombuffer(k.as_py(), np.uint64) for k in t["keys"]]))
        at = np.unique((keys[1:][keys[1:] == keys[:-1]] % np.uint64(bits)).astype(np.int64))
        if not len(at):
            return pa.table({"w": pa.array([], pa.int64()), "x": pa.array([], pa.int64())})
        first = np.flatnonzero(np.concatenate([[True], np.diff(at >> 6) != 0]))
        x = np.bitwise_or.reduceat(np.left_shift(np.int64(1), at & 63), first)
        return pa.table({"w": at[first] >> 6, "x": x})

    return run


BLOB = ("keys", "ranges", "stretch", "bytes", "of", "doc", "place", "ids")


def _stretches(length: int, gram: int, bits: int, words: np.ndarray, buckets: int):
    """Blobs of stretches of repeated anchors by bucket, each different stretch of a block once."""

    def block(ids, texts, got):
        cols = [np.concatenate(x) for x in zip(*got, strict=True)]
        doc, place, key, stretch, left, right = cols
        _, first, of = np.unique(stretch, return_index=True, return_inverse=True)
        bucket = ((key[first] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        flat = np.concatenate(texts)
        base = np.cumsum([0, *map(len, texts[:-1])])
        begin = base[doc[first]] + place[first] - left[first]
        size = left[first] + gram + right[first]
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        where = np.argsort(rank[of], kind="stable")  # places in the order of their stretches
        of_end = np.cumsum(np.bincount(rank[of], minlength=len(order)))
        rows = {"bucket": [], **{k: [] for k in BLOB}}
        for n, (lo, hi) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
            if lo == hi:
                continue
            at = order[lo:hi]
            p = where[(of_end[lo - 1] if lo else 0) : of_end[hi - 1]]
            used, index = np.unique(doc[p], return_inverse=True)
            s = size[at]
            rows["bucket"].append(n)
            rows["keys"].append(key[first][at].tobytes())
            rows["ranges"].append(np.stack([left[first][at], right[first][at]], 1).astype(np.uint8).tobytes())
            rows["stretch"].append(stretch[first][at].tobytes())
            rows["bytes"].append(flat[np.repeat(begin[at] - np.cumsum(s) + s, s) + np.arange(s.sum())].tobytes())
            rows["of"].append((rank[of[p]] - lo).astype(np.uint32).tobytes())
            rows["doc"].append(index.astype(np.uint16).tobytes())
            rows["place"].append(place[p].astype(np.uint64).tobytes() if place[p].max() >= 1 << 32 else place[p].astype(np.uint32).tobytes())
            rows["ids"].append(np.array(ids, np.int64)[used].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in BLOB)], ["bucket", *BLOB])

    def run(batches):
        ids, texts, got, size = [], [], [], 0
        for b in batches:
            for doc, row, t in zip(b["ord"].to_pylist(), b["row"].to_pylist(), text_bytes(b["text"]), strict=True):
                any_found = False
                for off, sums, place, h, lo, hi in anchors(t, length, gram):
                    at = (h % np.uint64(bits)).astype(np.int64)
                    keep = (words[at >> 6] >> (at & 63)) & 1 == 1
                    if not keep.any():
                        continue
                    place, h, lo, hi = place[keep], h[keep], lo[keep], hi[keep]
                    left, right = place - lo, hi + length - gram - place
                    key = mixed(span_hash(sums, lo, hi + length) ^ mixed(left.astype(np.uint64)))
                    got.append((np.full(len(h), len(ids)), place + off, h, key, left, right))
                    any_found = True
                if any_found:
                    ids.append((doc, row))
                    texts.append(t)
                    size += len(t)
                    if len(ids) >= DOCS or size > BYTES:
                        yield block(ids, texts, got)
                        ids, texts, got, size = [], [], [], 0
        if ids:
            yield block(ids, texts, got)

    return run


def candidate_groups(key, left, right, sums, start, length: int, gram: int):
    """For each stretch the number of its suffix-array group with shared bytes to the right, and to the left (-1: none).

    `half` bytes on one side of the anchor belong to every window that reaches less far to the other side.
    """
    half = (length - gram) // 2
    reach = length - gram - half
    n = len(key)
    anchor = start + left
    has_left, has_right = left > half, right >= reach
    l_sym = span_hash(sums, np.where(has_left, anchor - half - 1, anchor), anchor) ^ np.uint64(0x3333)
    r_sym = span_hash(sums, anchor + gram, np.where(has_right, anchor + gram + reach, anchor + gram)) ^ np.uint64(0x7777)
    names, symbol = np.unique(np.concatenate([l_sym, key, r_sym]), return_inverse=True)
    text = np.zeros((n, 4), np.int64)  # left bytes, anchor, right bytes, end mark
    text[:, 0] = np.where(has_left, symbol[:n] + 1, 0)
    text[:, 1] = symbol[n : 2 * n] + 1
    text[:, 2] = np.where(has_right, symbol[2 * n :] + 1, 0)
    keep = np.stack([has_left, np.ones(n, bool), has_right, np.ones(n, bool)], 1).ravel()
    flat = text.ravel()[keep]
    owner = np.repeat(np.arange(n), 4)[keep]
    role = np.tile(np.arange(4), n)[keep]
    array = suffix_array(flat)
    pair = np.stack([flat, np.append(flat[1:], 0)], 1)[array]
    new = np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)])
    run = np.cumsum(new) - 1
    several = np.bincount(run)[run] > 1
    to_right, to_left = np.full(n, -1), np.full(n, -1)
    good = several & (pair[:, 0] > 0) & (pair[:, 1] > 0)
    mine, what = owner[array], role[array]
    pick = good & (what == 1)
    to_right[mine[pick]] = run[pick]
    pick = good & (what == 0)
    to_left[mine[pick]] = run[pick]
    return to_right, to_left, half


def _removed(length: int, gram: int):
    """(ord, row, first, last): ranges of starts of removed windows, from all stretches of a bucket."""

    def run(t: pa.Table) -> pa.Table:
        blobs = [{k: t[k][i].as_py() for k in BLOB} for i in range(t.num_rows)]
        get = lambda k, kind: [np.frombuffer(b[k], kind) for b in blobs]
        keys, stretch, of = get("keys", np.uint64), get("stretch", np.uint64), get("of", np.uint32)
        ranges = np.concatenate(get("ranges", np.uint8)).reshape(-1, 2).astype(np.int64)
        flat = np.concatenate(get("bytes", np.uint8))
        place = np.concatenate([np.frombuffer(b["place"], np.uint32 if len(b["place"]) == len(b["of"]) else np.uint64).astype(np.int64) for b in blobs])
        own = [np.frombuffer(b["ids"], np.int64).reshape(-1, 2)[np.frombuffer(b["doc"], np.uint16)] for b in blobs]
        doc, row = np.concatenate([x[:, 0] for x in own]), np.concatenate([x[:, 1] for x in own])
        shift = np.cumsum([0, *map(len, keys[:-1])])
        of = np.concatenate([x.astype(np.int64) + s for x, s in zip(of, shift, strict=True)])
        keys, stretch = np.concatenate(keys), np.concatenate(stretch)
        size = ranges.sum(1) + gram
        start = np.cumsum(size) - size
        # equal stretches of several blocks are one
        _, first, same = np.unique(stretch, return_index=True, return_inverse=True)
        of, keys, left, right, start = same[of], keys[first], ranges[first, 0], ranges[first, 1], start[first]
        n = len(keys)
        order = np.lexsort((place, doc, of))
        of, doc, row, place = of[order], doc[order], row[order], place[order]
        head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))  # the first place of each stretch
        rank_of = np.empty(n, np.int64)
        rank_of[np.lexsort((place[head], doc[head]))] = np.arange(n)
        d0, p0 = doc[head], place[head]
        # all windows of later places go; those with the very first place (a repeated row) are as the first
        is_first = (doc == d0[of]) & (place == p0[of])
        out = [(doc[~is_first], row[~is_first], (place - left[of])[~is_first], (place + right[of] - (length - gram))[~is_first])]
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        shared = np.zeros(n, bool)
        eq = k[1:] == k[:-1]
        shared[order[1:][eq]] = True
        shared[order[:-1][eq]] = True
        some = np.flatnonzero(shared)  # anchors with several different stretches
        if len(some):
            sums = prefix_sums(flat)
            to_right, to_left, half = candidate_groups(keys[some], left[some], right[some], sums, start[some], length, gram)
            far, near = left[some], length - gram - right[some]  # windows reach from far to near bytes left of the anchor
            near = np.maximum(near, 0)
            count = far - near + 1
            who = np.repeat(np.arange(len(some)), count)
            x = np.repeat(near, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            group = np.where(x <= half, to_right[who], to_left[who])
            ok = group >= 0
            who, x, group = who[ok], x[ok], group[ok]
            begin = start[some][who] + left[some][who] - x
            window = mixed(span_hash(sums, begin, begin + length) ^ mixed((group * 256 + x).astype(np.uint64)))
            rank = rank_of[some][who]
            order = np.lexsort((rank, window))
            w = window[order]
            earliest = np.maximum.accumulate(np.where(np.concatenate([[True], w[1:] != w[:-1]]), np.arange(len(w)), 0))
            e = order[earliest]
            s_now, s_first = some[who[order]], some[who[e]]
            later = (d0[s_now] != d0[s_first]) | (p0[s_now] != p0[s_first])
            at = np.zeros(len(who), bool)
            at[order[later]] = True
            # runs of removed windows of each stretch's first place, all rows that share it
            hit = np.flatnonzero(at)
            if len(hit):
                s, y = some[who[hit]], x[hit]
                cut_at = np.concatenate([[True], (s[1:] != s[:-1]) | (y[1:] != y[:-1] + 1)])
                a = np.flatnonzero(cut_at)
                b = np.append(a[1:], len(s)) - 1
                runs_s, lo, hi = s[a], y[a], y[b]
                firsts = np.flatnonzero(is_first)
                by = np.argsort(of[firsts], kind="stable")
                firsts = firsts[by]
                lo_i = np.searchsorted(of[firsts], runs_s, "left")
                m = np.searchsorted(of[firsts], runs_s, "right") - lo_i
                i = firsts[np.repeat(lo_i - np.cumsum(m) + m, m) + np.arange(m.sum())]
                out.append((doc[i], row[i], place[i] - np.repeat(hi, m), place[i] - np.repeat(lo, m)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("ord", "row", "first", "last"), cols, strict=True)))

    return run


def kept(text: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What is left of a text without the windows whose starts lie in the ranges; bytes and runs that were removed."""
    if not len(first):
        return text.tobytes(), 0, 0
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return text[~gone].tobytes(), int(gone.sum()), spans


def removed_ranges(rows: DataFrame, length: int, gram: int, bits: int) -> DataFrame:
    """(ord, row, ranges): starts of removed windows of rows(ord, row, text)."""
    spark = rows.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.select("text").mapInArrow(_count(length, gram, bits, buckets), "bucket int, keys binary")
    got = counted.groupBy("bucket").applyInArrow(_repeated(bits), "w long, x long").toArrow()  # bits / 64 rows at most
    words = np.zeros(bits // 64, np.int64)
    words[got["w"].to_numpy()] = got["x"].to_numpy()
    schema = "bucket int, " + ", ".join(f"{k} binary" for k in BLOB)
    blobs = rows.select("ord", "row", "text").mapInArrow(_stretches(length, gram, bits, words, buckets), schema)
    found = blobs.groupBy("bucket").applyInArrow(_removed(length, gram), "ord long, row long, first long, last long")
    return found.groupBy("ord", "row").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))


def with_ranges(docs: DataFrame, length: int, gram: int = 40, bits: int = 1 << 26) -> DataFrame:
    """All rows and columns of docs(doc_id, text, ...) with `__first` and `__last`, the removed ranges (null: none)."""
    if not 0 < gram < length <= 250:
        raise ValueError("0 < gram < length <= 250")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = {"__ord": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__row": F.xxhash64(text)}
    rows = docs.select(key["__ord"].alias("ord"), key["__row"].alias("row"), text.alias("text"))
    ranges = removed_ranges(rows, length, gram, bits)
    ranges = ranges.withColumnsRenamed({k: f"__{k}" for k in ranges.columns})
    return docs.withColumns(key).join(ranges, [*key], "left")


def _ranges_of(b, i: int) -> tuple[np.ndarray, np.ndarray]:
    first, last = b["__first"][i], b["__last"][i]
    if not first.is_valid:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return first.values.to_numpy(), last.values.to_numpy()


def dedup_report(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs(doc_id, text)."""

    def run(batches):
        for b in batches:
            size, gone, spans, sha = [], [], [], []
            for i, t in enumerate(text_bytes(b["text"])):
                left, n, runs = kept(t, *_ranges_of(b, i), length)
                size.append(len(t))
                gone.append(n)
                spans.append(runs)
                sha.append(hashlib.sha256(left).hexdigest())
            cols = [pa.array(x, pa.int64()) for x in (size, gone, spans)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *cols, pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), length)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.select("doc_id", "text", "__first", "__last").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """All rows and columns of docs(doc_id, text, ...), repeated strings cut out of `text`.

    Bytes of a character of which a part was removed go with it, so the text stays valid. Other columns may have any name.
    """
    names, at = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*[n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(names)])
    rows = with_ranges(plain, length).select(*plain.columns, "__first", "__last")

    def run(batches):
        for b in batches:
            out = []
            for i, t in enumerate(text_bytes(b["text"])):
                if not b.column(at)[i].is_valid:
                    out.append(None)
                else:
                    out.append(kept(t, *_ranges_of(b, i), length)[0].decode("utf-8", "ignore"))
            cols = [pa.array(out, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from sigweave.session import table

    return dedup_report(table(spark, sf_dir, "documents"))
