"""Near-duplicate classes, repeated strings and suffix arrays against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from sigweave.llm import jaccard_join, links, suffix_dedup
from sigweave.llm.gsaca import suffix_array
from sigweave.llm.shingles import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(t):
    w = WORD.findall((t or "").translate(LOW))
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def plain_classes(rows):
    sets = {i: plain_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def copies(seed, n, vocabulary=200):
    r = random.Random(seed)
    base, rows = [], []
    for i in range(n):
        if base and r.random() < 0.6:
            w = list(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                if w:
                    w[r.randrange(len(w))] = f"w{r.randrange(vocabulary)}"
        else:
            w = [f"w{r.randrange(vocabulary)}" for _ in range(r.choice([0, 1, 3, 5, 6, 9, 20, 60, 150, 300]))]
        base.append(w)
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return rows


def test_set_hashes():
    for t in ("", "  ", "a", "A b", "a b c d e", "a b c d e f", "a b c d e a b c d e", "é Ü x y z\x0bq"):
        assert len(shingles(np.frombuffer(t.encode(), np.uint8))) == len(plain_set(t))
    get = lambda t: shingles(np.frombuffer(t.encode(), np.uint8)).tolist()
    assert get("ONE two") == get("one\n TWO") != get("two one")


@pytest.mark.parametrize("percent", [80, 60])
def test_linked_sets_share_a_key(percent):
    r, edges = random.Random(percent), jaccard_join.size_bands(percent)
    for _ in range(400):
        n = r.choice([1, 2, 3, 4, 5, 9, 10, 40, 200])
        a = np.array(r.sample(range(1 << 40), n), np.uint64)
        b = np.unique(np.concatenate([a[r.randint(0, n // 4) :], np.array(r.sample(range(1 << 40), r.randint(0, n // 4)), np.uint64)]))
        a = np.sort(a)
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            ka, kb = ({(x[0], k) for x in jaccard_join.levels_of(len(s), edges, percent) for k in jaccard_join.sketch_keys(s, *x).tolist()} for s in (a, b))
            assert ka & kb


@pytest.mark.parametrize("seed,limits", [(1, None), (2, (4, 1)), (3, (2000, 0))])
def test_classes_equal_brute_force(spark, monkeypatch, seed, limits):
    if limits:  # small blocks, few proposals
        monkeypatch.setattr(jaccard_join, "BLOCK", limits[0])
        monkeypatch.setattr(jaccard_join, "DOCS", 7)
    rows = copies(seed, 220)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_classes(rows)
    got = jaccard_join.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_odd_rows_of_the_join(spark):
    rows = [(5, "a b c d e f", 1), (3, "A b c d e f", 1), (3, "A b c d e f", 1), (None, "a b c d e f", 1), (7, None, 1), (8, " \n", 1), (9, "a", 1), (2, "a", 1)]
    rows.append((11, "w " * 50_000, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, None), (7, 7), (8, 8), (9, 2), (2, 2), (11, 11)], key=str)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, None, 7, 8, 2, 11], key=str)
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = links.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == dict.fromkeys(range(61), 0) | {100: 100, 101: 100, 103: 100}


def test_suffix_arrays():
    r = random.Random(1)
    for _ in range(3000):
        s = [r.randint(0, r.choice([1, 2, 3, 20])) for _ in range(r.randint(0, 40))]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def plain_removal(rows, length):
    first = {}
    for o, t in rows:
        for i in range(len(t) - length + 1):
            first[t[i : i + length]] = min(first.get(t[i : i + length], (1 << 64, 0)), (o, i))
    out = []
    for o, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < (o, i):
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((o, len(t), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed,length,chunk", [(1, 100, 1 << 18), (2, 60, 150), (3, 100, 97)])
def test_removal_equals_brute_force(spark, monkeypatch, seed, length, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "DOCS", 9)
    r = random.Random(seed)
    some = lambda n, a: "".join(r.choice(a) for _ in range(n))
    passages = [some(r.randint(90, 400), "abcde fgh") for _ in range(12)]
    rows = []
    for i in range(120):
        makers = [
            lambda: some(r.randint(0, 120), "abcde fgh"), lambda: r.choice(passages), lambda: r.choice(passages)[r.randint(0, 80) :],
            lambda: r.choice(passages)[: -r.randint(1, 80)], lambda: "a" * r.randint(0, 300), lambda: "ab é" * r.randint(0, 70),
        ]
        t = "".join(r.choice(makers)() for _ in range(r.randint(0, 6)))
        rows.append((i, rows[r.randrange(len(rows))][1] if rows and r.random() < 0.2 else t))
    rows += [(3, rows[3][1]), (7, "x" + rows[9][1]), (500, None), (501, "")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, ord int").repartition(5)
    got = sorted(tuple(x) for x in suffix_dedup.dedup_report(docs, length).collect())
    assert got == plain_removal([(o, (t or "").encode()) for o, t in rows], length)


def test_removal_keeps_columns_and_odd_rows(spark):
    long = "".join(random.Random(3).choices("abcdefgh ", k=400_000))
    rows = [(1, long, 1, "p"), (2, long[1000:2000], 2, "q"), (None, long[5:200], 3, "r"), (4, None, 4, "s"), (5, "", 5, "t"), (6, "ü" * 150, 6, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, first string")
    got = suffix_dedup.remove_repeats(docs)
    assert got.columns == docs.columns
    texts = {r.row: (r.text, r["first"]) for r in got.collect()}
    assert texts == {1: (long, "p"), 2: ("", "q"), 3: ("", "r"), 4: (None, "s"), 5: ("", "t"), 6: ("ü", "u")}
    assert suffix_dedup.dedup_report(docs.limit(0)).count() == 0


def test_parity_sketches_bound_the_difference():
    r = np.random.default_rng(5)
    for n, m in ((50, 60), (1000, 1200), (1500, 3000), (9000, 5000)):
        a, b = r.integers(0, 1 << 60, n).astype(np.uint64), r.integers(0, 1 << 60, m).astype(np.uint64)
        b[: min(n, m) // 2] = a[: min(n, m) // 2]
        x = jaccard_join.folded([jaccard_join.parity_bits(np.unique(s)) for s in (a, b)])
        assert int(np.bitwise_count(x[0] ^ x[1]).sum()) <= len(np.setxor1d(a, b))


def test_keys_travel_in_six_bytes():
    """Whole keys made the first shuffle a quarter larger. Keys that are alike in six bytes meet in one run; no member is lost."""
    import pyarrow as pa

    keys = np.array([7, 2**63 + 5, 2**64 - 1, 0], np.uint64)
    short = jaccard_join.packed_keys(keys)
    assert len(short) == 6 * len(keys)
    assert jaccard_join.unpacked_keys(short).tolist() == [int(k) % 2**48 for k in keys]
    one = lambda key, doc: (jaccard_join.packed_keys(np.array([key], np.uint64)), np.zeros(1, np.uint16).tobytes(), jaccard_join.packed_ids(np.array([doc])), np.array([doc]).tobytes())
    rows = [one(9, 1), one(9 + 2**50, 2), one(9, 3), one(10, 4)]
    got = jaccard_join._runs(pa.table(dict(zip(["keys", "own", "docs", "sets"], map(list, zip(*rows))))))
    assert sorted(got["doc_id"].to_pylist()) == [1, 2, 3] and len(set(got["run"].to_pylist())) == 1


def test_ids_travel_in_few_bytes():
    for ids, size in (([5, 7, 260], 1), ([-3, 2000], 2), ([0, 1 << 20], 4), ([-(2**63), 2**63 - 1], 8), ([4], 1)):
        short = jaccard_join.packed_ids(np.array(ids, np.int64))
        assert len(short) == 8 + size * len(ids)
        assert jaccard_join.unpacked_ids(short, len(ids)).tolist() == ids
