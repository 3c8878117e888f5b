"""Vector searches and host reputation: brute force and odd rows."""

import numpy as np
import pytest

from sigweave.llm import lsh_search, url_reputation, va_search


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<long>")


@pytest.mark.parametrize("seed,spread", [(1, 300), (2, 2)])
def test_exact_search_equals_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (300, 7))
    x[100:200] = x[5]  # a third of the rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = va_search.exact_top_k(vectors(spark, rows), 5, 10, block=64, queries_per_block=11).collect()
    want = set()
    for q in range(0, 300, 10):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_exact_search_odd_rows(spark):
    rows = [(0, [1, 2]), (0, [1, 2]), (1, None), (2, [None, 1]), (3, [2, 2]), (None, [9, 9]), (4, []), (10, []), (6, [1, 2, 3])]
    got = {tuple(r) for r in va_search.exact_top_k(vectors(spark, rows), 5, 5).collect()}
    assert got == {(0, 1, 3, 6), (10, 1, 4, 0)}
    assert va_search.exact_top_k(vectors(spark, rows).limit(0), 5, 5).count() == 0


@pytest.mark.parametrize("size", [1e6, 1e12, 1e20, 1e150])
def test_scores_of_any_size(spark, size):
    """Components far beyond what products in 64 bits can hold keep their exact order."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(60, 5)) * size)
    x[30:40, 1:] = x[30, 1:]
    x[31, 0] = np.nextafter(x[30, 0], np.inf) if size > 2**52 else x[30, 0] + 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = va_search.exact_top_k(spark.createDataFrame(rows, "id long, v array<double>"), 5, 10, block=16).collect()
    score = lambda a, b: sum(int(p) * int(q) for p, q in zip(x[a].tolist(), x[b].tolist()))
    long = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = {(q, r + 1, i, long(-s)) for q in range(0, 60, 10) for r, (s, i) in enumerate(sorted((-score(q, i), i) for i in range(60) if i != q)[:5])}
    assert {tuple(r) for r in got} == want


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, q = rng.integers(-500, 500, (200, 9)).astype(float), rng.integers(-500, 500, (20, 9))
    for bits in (1, 4, 6):
        assert (va_search.upper_bounds(q, *va_search.approximate(x, bits)) >= q @ x.T).all()


def test_recall_of_the_hashing_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    x[400:900] = x[7]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got: dict[int, list] = {}
    for r in lsh_search.nearest(docs, 10, 50, bucket_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 1500, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        assert got[q] == sorted(got[q], key=lambda p: (p[1], p[0])) and len(got[q]) == 10
        assert all(abs(s - d[v]) < 1e-12 for v, s in got[q])
        hit += len({v for v, _ in got[q]} & set(best.tolist()))
    assert hit / 300 >= 0.9


def test_hashing_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [1.0]), (None, [1.0, 0.0])]
    docs = spark.createDataFrame(rows, "id long, v array<double>")
    assert {tuple(r) for r in lsh_search.nearest(docs, 10, 10).collect()} == {(0, 1, 7, 0.0)}
    assert lsh_search.nearest(docs.limit(0), 10, 10).count() == 0


def test_far_queries_get_their_exact_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8)) * 0.01  # one tight cluster, near copies, and rows far from all others
    x[::50] = rng.normal(size=(12, 8)) * 1000
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got: dict[int, list] = {}
    for r in lsh_search.nearest(docs, 10, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 600, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert got[q] == np.lexsort((np.arange(600), d))[:10].tolist()


@pytest.mark.parametrize("at,spread", [(0, 1.0), (0, 1e-170), (0, 1e160), (1e6, 1e-7), (0, 0.0)])
def test_rows_left_out_by_products_are_not_among_the_nearest(at, spread):
    """Ties, rows that rounding cannot tell apart, numbers whose squares are no numbers, and the query itself."""
    rng = np.random.default_rng(6)
    x, q = at + rng.integers(-3, 4, (400, 6)) * spread, at + rng.integers(-3, 4, (30, 6)) * spread
    x[:30], own, qid = q, rng.permutation(400), np.arange(30)
    want = []
    with np.errstate(over="ignore"):
        for i in range(30):
            d = np.sqrt(((x - q[i]) ** 2).sum(1))
            best = [j for j in np.lexsort((own, d)) if own[j] != qid[i]][:10]
            want += [(i, own[j], d[j]) for j in best]
        row, vid, d = lsh_search.closest(x, own, q, qid, 10, np.full(30, np.inf))
    assert list(zip(row, vid, d, strict=True)) == want
    # buckets of many sizes, some visited by no query, rows that lie in two of them
    bucket = np.r_[rng.integers(0, 9, 400) ** 2, np.full(400, 100)]
    query, probe = np.repeat(np.arange(30), 9), np.tile(np.r_[np.arange(1, 9) ** 2, 7], 30)
    both = np.tile(np.arange(400), 2)
    with np.errstate(over="ignore"):
        row, vid, d = lsh_search.in_buckets(x[both], own[both], bucket, q, qid, np.r_[query, 0], np.r_[probe, 100], 10)
    for i in range(30):
        seen = np.unique(both[(bucket > 0) & ((bucket < 100) | (i == 0))])
        with np.errstate(over="ignore"):
            far = np.sqrt(((x[seen] - q[i]) ** 2).sum(1))
        best = [seen[j] for j in np.lexsort((own[seen], far)) if own[seen[j]] != qid[i]][:10]
        assert vid[row == i].tolist() == own[best].tolist()


def test_few_distances_are_taken_component_by_component(monkeypatch):
    rng = np.random.default_rng(2)
    x, q, taken = rng.normal(size=(6000, 16)), rng.normal(size=(50, 16)), []
    leading = lsh_search.leading
    monkeypatch.setattr(lsh_search, "leading", lambda row, *rest: (taken.append(len(row)), leading(row, *rest))[1])
    lsh_search.in_buckets(x, np.arange(6000), np.arange(6000) // 2000, q, np.arange(50) + 9000, np.repeat(np.arange(50), 3), np.tile(np.arange(3), 50), 10)
    assert sum(taken) < 0.03 * 50 * 6000


def test_vectors_are_dealt_to_their_groups_in_one_exchange(spark, monkeypatch):
    plans, cut = [], lsh_search.cut
    monkeypatch.setattr(lsh_search, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "id long, v array<float>")
    lsh_search.nearest(docs, 5, 10, bucket_rows=20).collect()
    (found,) = (p for p in plans if "FlatMapCoGroupsInArrow" in p)
    assert "SortMergeJoin" not in found and found.count("Exchange hashpartitioning") == 3  # rows and probes by group, results by query
    assert "SortAggregate" not in found  # rows are stored once before


def test_probes_come_in_order_of_success():
    q = np.array([[0.1, 3.7]])
    rows, cells = lsh_search.probe_cells(q, 1.0, 0.9, 3)
    assert cells[0].tolist() == [0, 3] and len(np.unique(cells, axis=0)) == len(cells) and (rows == 0).all()


def test_urls_and_rules(spark):
    urls = [
        None, "", "no url", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com?en", "x://a.net/es/", "x://net/fr/1", "x://anet/fr/1",
        "http://ex.com/é", "http://a.b.example.com/en/", "ftp://h.org#/en/", "a://b://c/d",
    ]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(6, 0), (6, 1), (7, None), (None, 1)], "doc_id long, quality int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_pages(pages, labels).collect()}
    assert got[0][:3] == got[1][:3] == got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[5][:3] == ("example.com", "", None)
    assert got[6] == ("a.net", "/es/", "net/es/", "block") and got[7] == ("net", "/fr/1", "net/fr/", "block")
    assert got[8][2] is None and got[9] == ("ex.com", "/é", "com/", "allow")
    assert got[10] == ("a.b.example.com", "/en/", "example.com/en/", "block")
    assert got[11][:3] == ("h.org", "", None) and got[12][:3] == ("b:", "//c/d", None)
    assert url_reputation.judge_pages(pages.limit(0), labels).count() == 0
    none = url_reputation.judge_pages(pages, labels.limit(0))
    assert {r.verdict for r in none.where("rule is null").collect()} == {"allow"}


def test_bad_hosts_are_blocked_and_small_ones_spared(spark):
    rows = [(i, f"http://bad.a.org/{i}", 0) for i in range(60)] + [(100 + i, f"http://good.b.org/{i}", 1) for i in range(60)]
    rows += [(200, "http://new.b.org/1", 0), (201, "http://unseen.a.org/1", None)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    verdict = {r.host: r.verdict for r in url_reputation.judge_pages(pages, labels).collect()}
    assert verdict["bad.a.org"] == "block" and verdict["good.b.org"] == "allow" and verdict["new.b.org"] == "allow"
