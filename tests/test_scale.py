"""Hot groups, determinism, properties and plans."""

import random

import pytest
from pyspark.sql import functions as F

from sigweave.operators import corpus, evaluate, graph, labels, retrieval
from sigweave.operators.ranking import distributed_rank, hash_rank, previous_in_group
from sigweave.plans import QUERIES
from sigweave.session import cut


def test_distributed_rank_with_a_hot_group(spark):
    n = 3000
    d = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), ((F.col("id") * 7919) % 101).alias("v"), "id", (F.col("id") % 2).alias("g"))
    r = distributed_rank(d.repartition(6), ["k"], [F.col("v").desc(), F.col("id")], size_col="n")
    rows = r.collect()
    groups = {}
    for x in rows:
        groups.setdefault(x["k"], []).append(x)
    assert sum(len(v) for v in groups.values()) == n
    for v in groups.values():
        v.sort(key=lambda x: (-x["v"], x["id"]))
        for i, x in enumerate(v, 1):
            assert (x["rn"], x["n"]) == (i, len(v))


def test_precision_of_a_hot_feature(spark):
    d = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("other").alias("feature"), "id", (F.col("id") * 37 % 101 / 101).alias("score"), (F.col("id") % 7 == 0).cast("int").alias("g"))
    got = {r["feature"]: (r["n"], r["n_pos"], r["ap"]) for r in evaluate.average_precision(d.repartition(5), "id").collect()}
    for f in ("hot", "other"):
        rows = sorted(((-r["score"], r["id"], r["g"]) for r in d.collect() if r["feature"] == f))
        tp, total = 0, 0.0
        for i, (_, _, g) in enumerate(rows, 1):
            tp += g
            total += g * tp / i
        assert got[f] == (len(rows), tp, pytest.approx(total / tp, abs=1e-6))


def test_rank_takes_one_exchange_of_rows(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    plan = _plan(distributed_rank(d, ["k"], [F.col("id")]))
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_hash_rank_is_a_permutation_of_each_group(spark):
    d = spark.range(2000).select((F.col("id") % 5 == 0).alias("k"), "id", F.md5(F.col("id").cast("string")).alias("h"))
    rows = hash_rank(d, ["k"], "h", "id").collect()
    for k in (True, False):
        g = sorted((x["h"], x["id"], x["rn"]) for x in rows if x["k"] == k)
        assert [x[2] for x in g] == list(range(1, len(g) + 1))


def test_previous_in_group_with_copies(spark):
    d = spark.range(900).select(F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("p"), "id")
    got = {r["id"]: r["prev"] for r in previous_in_group(d, ["p"], [F.col("id")], "id", "prev").collect()}
    assert all(got[i] == (i - 3 if i % 3 == 0 and i > 0 else None) for i in got) and len(got) == 900


def test_near_dup_reads_blank_runs_as_one(spark):
    long_gap = "a" + " " * 500 + "b" + "c" * 100
    d = spark.createDataFrame([(1, "A b" + "c" * 100), (2, long_gap), (3, "other text"), (4, "a  b" + "c" * 77 + "z")], "id int, t string")
    got = {r["id"]: r["previous"] for r in corpus.near_dup(d, "id", "t").collect()}
    assert got == {2: 1, 4: 2}  # the first 80 folded characters agree; what follows does not matter


def test_splits_are_disjoint_complete_and_stable(spark):
    d = spark.range(1000).select("id", (F.col("id") % 4 == 0).alias("gold"))
    s = lambda df: {r["id"]: r["split"] for r in labels.stratified_split(df, "id", F.col("gold"), {True: (0.3, 0.3), False: (0.05, 0.05)}).collect()}
    a, b = s(d), s(d.repartition(9))
    assert a == b and len(a) == 1000
    assert sum(v == "test" for v in a.values()) == 75 + 37


def test_rrf_does_not_depend_on_list_order(spark):
    rng = random.Random(1)
    lists = [spark.createDataFrame([(1, i, k) for k, i in enumerate(rng.sample(range(30), 15))], "q int, d int, rank int") for _ in range(3)]
    a = retrieval.rrf(lists, "q", "d").collect()
    b = retrieval.rrf(lists[::-1], "q", "d").collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("lam", [0.0, 0.35, 1.0])
def test_recalibration_keeps_magnitude(spark, lam):
    v = spark.createDataFrame([("f", "x", "a", 0.6), ("f", "x", "b", 0.3), ("g", "y", "a", 0.5)], "feature string, value string, outcome string, weight double")
    q = spark.createDataFrame([("value:f=x", "pattern:b", 9), ("value:f=x", "pattern:zzz", 5)], "src string, dst string, n bigint")
    got = graph.recalibrate(v, q, lam).collect()
    assert sum(r["weight"] for r in got if r["feature"] == "f") == pytest.approx(0.9, abs=1e-5)
    assert [r["weight"] for r in got if r["feature"] == "g"] == [0.5]


def test_sweep_equals_direct_counts(spark):
    rng = random.Random(2)
    rows = [("f", i, round(rng.random(), 2), rng.randint(0, 1)) for i in range(400)]
    d = spark.createDataFrame(rows, "feature string, id int, score double, g int")
    grid = [0.2, 0.25, 0.5, 0.8]
    for strict in (True, False):
        for r in evaluate.sweep_counts(d, grid, strict=strict).collect():
            hit = lambda s: s > r["threshold"] if strict else s >= r["threshold"]  # noqa: E731, B023
            assert r["tp"] == sum(1 for x in rows if hit(x[2]) and x[3])
            assert r["fp"] == sum(1 for x in rows if hit(x[2]) and not x[3])
            assert r["fn"] == sum(1 for x in rows if not hit(x[2]) and x[3])


def test_neighborhood_with_cycles_and_a_hub(spark):
    edges = [("a", "r", "b"), ("b", "r", "a"), ("b", "r", "c"), ("c", "s", "d")] + [(f"x{i}", "r", "a") for i in range(50)]
    e = spark.createDataFrame(edges, "src string, rel string, dst string")
    s = spark.createDataFrame([(1, "a")] + [(10 + i, f"x{i}") for i in range(50)], "entity int, node string")
    got = {(r["entity"], r["node"]): r["hop"] for r in graph.neighborhood(s, e, 2, ["r"]).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {"a": 0, "b": 1, "c": 2}
    assert {k[1]: v for k, v in got.items() if k[0] == 12} == {"x2": 0, "a": 1, "b": 2}
    und = {r["node"] for r in graph.neighborhood(spark.createDataFrame([(1, "c")], "entity int, node string"), e, 2, ["r"], directed=False).collect()}
    assert und == {"c", "b", "a"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_manifest_never_reads_text(spark, sf):
    assert "text" not in _plan(QUERIES["j1_build_manifest"](spark, sf))


def test_label_store_is_a_projection_after_two_joins(spark, sf):
    plan = _plan(QUERIES["u2_label_store"](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["g6_neighborhood", "j9_verbatim_items", "w12_near_dup", "a13_average_precision", "r1_tfidf", "g9_rank_evidence"])
def test_no_cartesian_products(spark, sf, name):
    assert "CartesianProduct" not in _plan(QUERIES[name](spark, sf))


def test_streams_do_not_depend_on_the_session_zone(spark, sf):
    zone = spark.conf.get("spark.sql.session.timeZone")
    a = sorted(map(tuple, QUERIES["st3_stream_trend"](spark, sf).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        b = sorted(map(tuple, QUERIES["st3_stream_trend"](spark, sf).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert a == b and a


@pytest.mark.parametrize("bound", [0, 1 << 30])
def test_results_do_not_depend_on_broadcasts(spark, sf, monkeypatch, bound):
    """Joins with measured tables, on both sides of the bound."""
    from oracle import compare, duck

    from sigweave import dims
    from sigweave.plans import ORACLES

    monkeypatch.setattr(dims, "BROADCAST_BYTES", bound)
    con = duck(sf)
    for name in ("r1_tfidf", "j9_verbatim_items", "g9_rank_evidence"):
        msg, ok = compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
        assert ok, msg


def test_lexical_index_moves_no_text(spark, sf):
    plan = _plan(QUERIES["r1_tfidf"](spark, sf))
    assert "FileScan" not in plan and "text" not in plan  # the ranking reads stored terms and weights only


def test_images_are_dealt_out_before_they_become_pixels(spark, sf):
    """Whole images are exchanged, and whole columns with their distances; pixels never are."""
    lines = [x for x in _plan(QUERIES["z1_zone_stats"](spark, sf)).split("\n") if "Exchange" in x or "Generate" in x]
    moved = [x for x in lines if "Exchange" in x]
    assert len(moved) == 2 and all("REPARTITION_BY" in x for x in moved) and any("Generate" in x for x in lines)


def test_induced_edges_read_stored_tables(spark, sf):
    assert _plan(QUERIES["g7_induced"](spark, sf)).count("FileScan") == 0


def test_seeds_outside_the_graph_are_left_out(spark):
    e = spark.createDataFrame([("a", "r", "b")], "src string, rel string, dst string")
    s = spark.createDataFrame([(1, "a"), (1, "zzz")], "entity int, node string")
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {r["node"] for r in graph.neighborhood(s, e, 1, nodes=n).collect()} == {"a", "b"}


def test_every_window_of_a_stream_comes_out(spark, tmp_path):
    import datetime

    from sigweave.streaming import scoring

    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    batches = [[(1, at(10, 5), 7, "a", 1.0, "")], [(2, at(1, 5), 7, "a", 3.0, ""), (3, at(10, 9), 7, "a", 2.0, "")]]
    for i, rows in enumerate(batches):  # the second batch is late
        spark.createDataFrame(rows, scoring.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = scoring.event_stream(spark, str(tmp_path / "events"))
    got = [(r["n"], r["mean_cents"], r["closed"]) for r in scoring.stream_trend(stream, "value").orderBy("start").collect()]
    assert got == [(1, 300.0, True), (2, 150.0, False)]


def test_lines_are_made_in_many_tasks(spark, sf, monkeypatch):
    """Tasks are cut by entry nodes, not by bytes: a few bytes of entries become many lines."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(graph, "ENTRIES", 20, raising=False)
    lines = QUERIES["g9_evidence_list"](spark, sf)
    per = lines.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("entity").alias("n")).agg(F.count("*"), F.max("n")).first()
    assert per[0] >= 3 and per[1] <= 20


def test_keys_are_counted_without_being_shuffled(spark, sf, monkeypatch):
    """Looking for hubs shuffles one row per hash value and task, and a walk without hubs stores no edges."""
    stored = []
    monkeypatch.setattr(graph, "cut", lambda df: stored.append(df.columns) or cut(df))
    e = spark.range(20_000).select(F.concat(F.lit("n"), F.col("id") % 5000).alias("src"), F.lit("r").alias("rel"), F.col("id").cast("string").alias("dst"))
    assert graph._frequent(e, "src", "_blocks") is None and stored == [["_slot", "_n"]]
    monkeypatch.setattr(graph, "HUB", 3)
    monkeypatch.setattr(graph, "SHARE", 10_000)
    assert {tuple(x) for x in graph._frequent(e, "src", "_blocks").collect()} == {(f"n{i}", 2) for i in range(5000)}
    monkeypatch.undo()
    monkeypatch.setattr(graph, "cut", lambda df: stored.append(df.columns) or cut(df))
    stored.clear()
    seeds = spark.range(50).select(F.col("id").alias("entity"), F.concat(F.lit("n"), F.col("id")).alias("node"))
    assert graph.neighborhood(seeds, e, 1).count() == 50 * 5
    assert ["src", "dst"] not in stored
