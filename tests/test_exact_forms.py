"""Automaton, block-max ranking, greedy cover and distance transform against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.operators import automaton, matching, pixels, retrieval, sampling

# ---- dictionaries ------------------------------------------------------------------------------------


def found(items, texts):
    flat, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    pairs = list(zip(*(x.tolist() for x in automaton.Automaton(items).find(flat, at)), strict=True))
    assert len(pairs) == len(set(pairs))
    return set(pairs)


@pytest.mark.parametrize("seed", range(20))
def test_automaton_equals_containment(monkeypatch, seed):
    """Overlapping items, items inside items, cuts of texts and of items at any place, deep states outside the dense table."""
    r = random.Random(seed)
    for name, values in (("DENSE", [1, 9, 50, 1 << 22]), ("STRETCH", [2, 9, 1024]), ("ANCHOR", [2, 5, 2048]), ("FOUND", [2, 1 << 20])):
        monkeypatch.setattr(automaton, name, r.choice(values))
    letters = r.choice([b"ab", b"a", b"abc\x00\xff"])
    word = lambda n: bytes(r.choice(letters) for _ in range(n))
    items = sorted({word(r.randint(1, 12)) for _ in range(r.randint(0, 40))})
    texts = [word(r.choice([0, 1, 5, 60, 300])) for _ in range(r.randint(0, 20))]
    assert found(items, texts) == {(i, j) for i, t in enumerate(texts) for j, w in enumerate(items) if w in t}


def test_one_text_holds_a_large_dictionary():
    words = [f"term {i * 7919 % 1000003} x".encode() for i in range(100_000)]
    assert len(found(words, [b" ".join(words), b"nothing", words[5]])) == 100_001


@pytest.mark.parametrize("bound", [0, 1 << 22])
def test_substring_join_on_both_sides_of_the_bound(spark, bound):
    long = "start " + "word " * 3000 + "end"
    items = [(1, " a  B "), (2, "a b"), (2, "b c"), (3, None), (4, "  "), (5, long), (None, "ß Ω"), (6, "x")]
    texts = [("t", "zA\tb c"), ("t", "zA\tb c"), ("u", None), ("v", ""), ("w", "x " + long + " y"), (None, "ß Ω"), ("x", "start " + "word " * 2999 + "end")]
    got = matching.contains_join(spark.createDataFrame(texts, "item string, text string"), "item", "text", spark.createDataFrame(items, "id int, label string"), "id", "label", max_bytes=bound)
    fold = lambda s: " ".join((s or "").lower().split())
    want = Counter((t, i) for t, x in texts for i, w in items if fold(w) and fold(w) in fold(x))
    if not bound:  # the anchored join reads rows that repeat an id as one
        want = Counter({k: n for k, n in want.items()})
        assert {tuple(r) for r in got.collect() if None not in tuple(r)} == {k for k in want if None not in k}
    else:
        assert Counter(tuple(r) for r in got.collect()) == want
    none = spark.createDataFrame([], "id int, label string")
    assert matching.contains_join(spark.createDataFrame(texts, "item string, text string"), "item", "text", none, "id", "label").count() == 0


# ---- lexical ranking ---------------------------------------------------------------------------------


def plain_tfidf(docs, queries, stop, pool):
    import regex

    def terms(t):
        w = [x for x in regex.findall(r"[\p{L}\p{N}_]{2,}", (t or "").lower()) if x not in stop]
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    d, q = {k: terms(t) for k, t in docs}, {k: terms(t) for k, t in queries}
    df = Counter(x for c in d.values() for x in c)
    idf = {x: math.log((1 + len(docs)) / (1 + n)) + 1 for x, n in df.items()}
    norm = lambda c: math.sqrt(sum((n * idf[x]) ** 2 for x, n in c.items() if x in idf))
    out = {}
    for k, c in q.items():
        s = {i: sum(n * idf[x] * e[x] * idf[x] for x, n in c.items() if x in e) / (norm(e) * norm(c)) for i, e in d.items() if any(x in e for x in c)}
        out[k] = sorted(((-math.floor(v * 1e9 + 0.5) / 1e9, i) for i, v in s.items()))[:pool]
    return {(k, i, n): -s for k, x in out.items() for n, (s, i) in enumerate(x)}


@pytest.mark.parametrize("block", [40, 4096])
def test_tfidf_equals_brute_force(spark, block):
    r = random.Random(block)
    vocab = [f"w{int(r.paretovariate(0.8))}" for _ in range(500)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    docs = [(f"d{i}", text(r.choice([0, 1, 5, 30, 200]))) for i in range(150)] + [("dn", None)] + [(f"c{i}", "same words here and there") for i in range(60)]
    queries = [(i, text(8)) for i in range(12)] + [(90, "same words"), (91, "unknown"), (92, None)]
    got = retrieval.tfidf_topk(spark.createDataFrame(docs, "id string, t string").repartition(4), "id", "t", spark.createDataFrame(queries, "q int, t string"), "q", "t", ["and"], 7, block)
    rows = {(x.q, x.id, x["rank"]): x.score for x in got.collect()}
    want = plain_tfidf(docs, queries, {"and"}, 7)
    assert set(rows) == set(want) and all(rows[k] == pytest.approx(want[k], abs=2e-9) for k in want)


def test_terms_are_stored_and_moved_by_block(spark, monkeypatch):
    """What is stored has one row per text at most, not one per document and term; small blocks and buckets, and a text longer
    than a block, change nothing; a term of all documents goes to its bucket once per block."""
    monkeypatch.setattr(retrieval, "BLOCK_WORDS", 60, raising=False)
    monkeypatch.setattr(retrieval, "BUCKET_BYTES", 500, raising=False)
    stored, keep = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df: stored.append(keep(df)) or stored[-1])
    r = random.Random(5)
    text = lambda n: " ".join(["tous", *(f"é{int(r.paretovariate(0.7))}" for _ in range(n))])
    docs = [(i, text(r.choice([3, 12, 40]))) for i in range(90)] + [(100, text(700)), (101, "a . b"), (102, None)]
    queries = [(f"q{i}", text(6)) for i in range(9)] + [("none", ""), ("new", "nowhere tous")]
    d, q = spark.createDataFrame(docs, "id int, t string").repartition(3), spark.createDataFrame(queries, "q string, t string")
    rows = {(x.q, x.id, x["rank"]): x.score for x in retrieval.tfidf_topk(d, "id", "t", q, "q", "t", ["and"], 7).collect()}
    want = plain_tfidf(docs, queries, {"and"}, 7)
    assert set(rows) == set(want) and all(rows[k] == pytest.approx(want[k], abs=2e-9) for k in want)
    assert sum(x.count() for x in stored) <= len(docs) + len(queries)
    blocks = keep(retrieval.term_blocks(d, "id", "t", ["and"], 4))
    hot = blocks.select("_b", F.explode(F.arrays_zip("_terms", "_n"))).filter("col._terms = 'tous'").select("_b", "col._n").collect()
    assert len(hot) == blocks.filter("_k < 0").count() < 91 and sum(x["_n"] for x in hot) == 91


def test_fused_ranking_stores_a_row_per_text(spark, sf, monkeypatch):
    """Fusion ranks the same lexical index: it stores texts with their asked terms, never documents times terms."""
    from sigweave.plans import QUERIES

    stored, keep = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df: stored.append(keep(df)) or stored[-1])
    rows = QUERIES["r3_rrf"](spark, sf).count()
    texts = [spark.read.parquet(f"{sf}/{x}.parquet").count() for x in ("documents", "benchmark")]
    assert rows == 5 * texts[1] and stored and sum(x.count() for x in stored) <= sum(texts)


def shuffled_bytes(spark) -> int:
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_terms_move_in_few_bytes(spark):
    """The shuffles move less than six times the bytes of texts whose terms are nearly all different, and rows from blocks to
    buckets do not grow with both: a million words make two or three rows of blocks."""
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 12))) for _ in range(20000)]
    docs = [(i, " ".join(r.choices(vocab, k=500))) for i in range(400)]
    d, q = spark.createDataFrame(docs, "id int, t string").repartition(2), spark.createDataFrame([(1, " ".join(vocab[:5]))], "q int, t string")
    before = shuffled_bytes(spark)
    retrieval.tfidf_topk(d, "id", "t", q, "q", "t", [], 7)
    text = sum(len(t) for _, t in docs)
    assert shuffled_bytes(spark) - before < 6 * text
    long = spark.createDataFrame([(i, " ".join(r.choices(vocab[:99], k=500))) for i in range(2000)], "id int, t string").coalesce(1)
    assert retrieval.term_blocks(long, "id", "t", [], 4).filter("_k < 0").count() <= 3


def test_words_are_runs_of_two_letters_or_more():
    """Texts split in bulk have the words that a regular expression finds in each: nulls, empty texts, words at both ends of a
    text, single characters of one to four bytes, slices of a batch."""
    import pyarrow as pa
    import regex

    r = random.Random(1)
    texts = [None, "", "a", "é", "ab", "cd", "😀", "𝒜𝒜 𝒜 b", "日本 語", None, "_", "x"] + ["".join(r.choice("ab1_ .é日本𝒜😀\n-ßñ٣") for _ in range(r.randrange(14))) for _ in range(3000)]
    for some in (texts, texts[3:4], texts[:2], [], ["ab", "cd"]):
        for lo in (0, 1):
            n, words = retrieval.split_words(pa.array(some, pa.string()).slice(lo))
            want = [regex.findall(r"[\p{L}\p{N}_]{2,}", t or "") for t in some[lo:]]
            assert n.tolist() == [len(x) for x in want] and words.to_pylist() == [x for y in want for x in y]


def test_runs_below_the_kth_score_are_not_scored():
    """Documents of other subjects share the common terms of a query only: their runs are left out, the result is whole."""
    rng = np.random.default_rng(3)
    n, subjects = 4000, 40
    dt, dw, dn = [], [], []
    for _ in range(n):
        own = 1000 + 50 * rng.integers(subjects)
        t = np.concatenate([np.arange(5), own + rng.choice(50, 20, replace=False)])
        w = np.concatenate([np.full(5, 0.02), rng.uniform(0.1, 0.3, 20)])
        dt.append(t), dw.append(w / np.linalg.norm(w)), dn.append(len(t))
    qt, qw, qn = [], [], []
    for s in range(subjects):
        qt.append(np.concatenate([np.arange(5), 1000 + 50 * s + np.arange(10)]))
        qw.append(np.full(15, 15**-0.5)), qn.append(15)
    args = (np.arange(n), np.array(dn), np.concatenate(dt), np.concatenate(dw), np.array(qn), np.concatenate(qt), np.concatenate(qw), 10)
    d, a, s, scored = retrieval.best_of_block(*args)
    assert scored < n * subjects / 10  # every document shares a term with every query
    for i in range(subjects):
        ask = dict(zip(qt[i].tolist(), qw[i].tolist(), strict=True))
        score = np.floor(np.array([sum(ask.get(x, 0) * y for x, y in zip(t.tolist(), w.tolist(), strict=True)) for t, w in zip(dt, dw, strict=True)]) * 1e9 + 0.5) / 1e9
        assert d[a == i].tolist() == np.lexsort((np.arange(n), -score))[:10].tolist()


def test_lexical_ranking_sends_few_rows(spark, sf):
    """Rows that leave the tasks: k per query and block, not one per document and query with a common term."""
    from sigweave.plans import texts

    ranked = texts.lexical(spark, sf)
    rows = ranked.count()
    pairs = spark.read.parquet(f"{sf}/documents.parquet").count() * spark.read.parquet(f"{sf}/benchmark.parquet").count()
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert rows <= 15 * pairs / 100 and "FlatMapCoGroupsInArrow" in plan and plan.count("SortMergeJoin") == 0


# ---- greedy cover ------------------------------------------------------------------------------------


def serial_cover(rows, quotas, n, h):
    order = sorted(rows, key=lambda r: (h(r[0]), r[0]))
    filled, picks = [0] * len(quotas), []
    hit = lambda r, i: r[1 + quotas[i][0]] == quotas[i][1] and filled[i] < quotas[i][2]
    while len(picks) < n:
        best, gain = None, 0
        for r in order:
            if r not in picks and (g := sum(hit(r, i) for i in range(len(quotas)))) > gain:
                best, gain = r, g
        if best is None:
            break
        picks.append(best)
        for i in [i for i in range(len(quotas)) if hit(best, i)]:
            filled[i] += 1
    by = ["quota"] * len(picks)
    for r in order:
        if len(picks) < n and r not in picks:
            picks.append(r)
    return [(r[0], k + 1, by[k] if k < len(by) else "fill") for k, r in enumerate(picks)]


@pytest.mark.parametrize("seed", range(6))
def test_cover_equals_the_serial_loop(spark, seed):
    import hashlib

    r = random.Random(seed)
    rows = [(i, *[r.choice(["x", "y", "z", None]) for _ in range(3)]) for i in range(r.choice([0, 5, 200]))]
    quotas = [(c, v, r.randint(0, 8)) for c in range(3) for v in ("x", "y")]
    n = r.choice([3, 20, 60])
    d = spark.createDataFrame(rows, "id int, c0 string, c1 string, c2 string")
    got = sampling.quota_sample(d.repartition(3), "id", [(f"c{c}", v, q) for c, v, q in quotas], n)
    h = lambda i: hashlib.md5(f"11|{i}".encode()).hexdigest()
    assert sorted(tuple(x) for x in got.collect()) == sorted(serial_cover(rows, quotas, n, h))


# ---- distance transform ------------------------------------------------------------------------------


def test_distances_equal_brute_force(spark):
    """Masks with holes, of several parts, on frames of several shapes, full and empty ones."""
    r, rows = random.Random(2), []
    frames = [(5, 9, 0.5), (12, 12, 0.9), (1, 7, 0.6), (7, 1, 0.6), (30, 20, 0.97), (4, 4, 1.0), (4, 4, 0.0)]
    for image, (w, h, share) in enumerate(frames):
        rows += [(image, x, y, r.random() < share, 7) for x in range(w) for y in range(h)]
    px = spark.createDataFrame(rows, "image int, x int, y int, mask boolean, c0 int").repartition(5)
    got = pixels.mask_distance(px).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"image", "x", "y", "mask", "c0", "dist"}
    outside = {i: [(x, y) for j, x, y, m, _ in rows if j == i and not m] for i in range(len(frames))}
    for p in got:
        want = min((math.hypot(p.x - a, p.y - b) for a, b in outside[p.image]), default=None)
        assert p.dist == (want if want is None else pytest.approx(want, abs=1e-12))
    zoned = pixels.ring_zones(pixels.mask_distance(px).filter("mask"))
    assert {x.ring for x in zoned.filter("image = 5").collect()} == {"center"}
    far = {x.image: x.m for x in zoned.groupBy("image").agg(F.max("dist").alias("m")).collect()}
    for p in (p for p in zoned.filter("image < 5").collect() if far[p.image]):
        share = p.dist / far[p.image]
        assert p.ring == ("center" if share >= 0.55 else "edge" if 0.10 < share <= 0.35 else "other")


def test_end_widths_at_halves_do_not_hang_on_floating_sums(spark):
    """The mean |w| of one end is half a millionth over 0.250950, as wide as the other end's once it is rounded up."""
    w = [0.25095, 0.250951, 0.1, 0.1, 0.1, 0.1, 0.250951, 0.250951]
    for order in (1, -1):
        rows = [(1, i, 0, float(order * i), x) for i, x in enumerate(w)]
        got = pixels.axis_zones(spark.createDataFrame(rows, "image int, x int, y int, t double, w double")).collect()
        assert {r["x"] for r in got if r["third"] == "tip"} == ({0, 1, 2} if order == 1 else {5, 6, 7})  # equal widths: t is turned
