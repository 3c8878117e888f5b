"""Percentiles by radix selection, head training by Newton steps, walks through hubs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.operators import graph, percentile, training


def test_percentiles_of_any_doubles(spark):
    """All rows in one hot group but a few; negative, tiny, huge, equal and missing values."""
    r = random.Random(1)
    hot = [r.choice([r.gauss(0, 1), r.gauss(0, 1e-300), r.uniform(-1e300, 1e300), 0.0, -0.0, 7.25, float(r.randrange(5))]) for _ in range(4000)]
    rows = [("hot", v) for v in hot] + [("one", 3.5), ("two", -1.0), ("two", 2.0), ("none", None), ("nan", float("nan")), ("inf", float("inf")), ("inf", 1.0), (None, 4.0)]
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    d = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {(x.g, x.share): x.value for x in percentile.exact_percentiles(d, ["g"], "v", shares).collect()}
    for s in shares:
        assert got[("hot", s)] == pytest.approx(float(np.quantile(np.array(hot), s)), rel=1e-12)
        assert got[("one", s)] == 3.5 and got[("two", s)] == pytest.approx(-1 + 3 * s)
    assert got[("inf", 1.0)] == float("inf") and ("none", 0.5) not in got and ("nan", 0.5) not in got
    exact = {(x.g, x.v) for x in percentile.at_ranks(d, ["g"], "v", spark.createDataFrame([("hot", k) for k in (0, 1, 1999, 3999)], "g string, rank long")).withColumnRenamed("value", "v").collect()}
    assert exact == {("hot", sorted(hot)[k]) for k in (0, 1, 1999, 3999)}


def data(seed, n, classes=3, d=5):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, d)), rng.integers(0, classes, n)
    x[np.arange(n), y] += 0.7
    return x, y, rng.uniform(0.2, 3, n)


@pytest.mark.parametrize("reg", [0.0, 0.05])
def test_the_gradient_is_zero_in_sql(spark, reg):
    import duckdb

    x, y, w = data(2, 400)
    df = spark.createDataFrame([(v.tolist(), int(c), float(u)) for v, c, u in zip(x, y, w)], "v array<double>, c int, w double").repartition(5)
    odd = spark.createDataFrame([(None, 1, 1.0), ([1.0] * 5, None, 1.0), ([9.0] * 5, 1, 0.0)], df.schema)
    heads = training.fit_head(df.unionByName(odd), "v", "c", "w", 3, reg)
    rows = [(i, j, *map(float, (v, c, u))) for i, (v_, c, u) in enumerate(zip(x, y, w)) for j, v in enumerate([*v_, 1.0])]
    con = duckdb.connect()
    con.execute("CREATE TABLE x(i INT, j INT, v DOUBLE, c DOUBLE, w DOUBLE)")
    con.executemany("INSERT INTO x VALUES (?, ?, ?, ?, ?)", rows)
    con.execute("CREATE TABLE h(k INT, j INT, a DOUBLE)")
    con.executemany("INSERT INTO h VALUES (?, ?, ?)", [(k, j, float(a)) for k, row in enumerate(heads) for j, a in enumerate(row)])
    worst = con.sql(f"""WITH z AS (SELECT i, k, sum(v*a) AS z FROM x JOIN h USING (j) GROUP BY 1, 2), p AS (SELECT i, k, exp(z)/sum(exp(z)) OVER (PARTITION BY i) AS p FROM z),
      g AS (SELECT k, j, sum(w*(p - CAST(c = k AS INT))*v)/(SELECT sum(w) FROM x WHERE j = 0) AS g FROM x JOIN p USING (i) GROUP BY 1, 2)
      SELECT max(abs(g + CASE WHEN j < 5 THEN {reg}*a ELSE 0 END)) FROM g JOIN h USING (k, j)""").fetchall()[0][0]
    assert worst < 1e-9


def test_heads_do_not_depend_on_the_order_of_rows(spark):
    x, y, w = data(5, 200)
    df = spark.createDataFrame([(v.tolist(), int(c), float(u)) for v, c, u in zip(x, y, w)], "v array<double>, c int, w double")
    a, b = (training.fit_head(df.repartition(n), "v", "c", "w", 3, 0.1) for n in (2, 7))
    assert np.allclose(a, b, atol=1e-10)
    with pytest.raises(ValueError):
        training.fit_head(df.limit(0), "v", "c", "w", 3, 0.1)


def walk(seeds, edges, hops):
    out, after = {}, {}
    for s, d in edges:
        after.setdefault(s, set()).add(d)
    for e, n in seeds:
        out.setdefault((e, n), 0)
    front = set(out)
    for h in range(1, hops + 1):
        front = {(e, d) for e, n in front for d in after.get(n, ())} - set(out)
        out |= dict.fromkeys(front, h)
    return out


@pytest.mark.parametrize("hub", [5, 10_000])
def test_walks_through_a_hub(spark, monkeypatch, hub):
    """A star whose hub holds half of all edges, and half of all entities standing at the hub."""
    monkeypatch.setattr(graph, "HUB", hub)
    r = random.Random(3)
    edges = [("hub", f"n{i}") for i in range(120)] + [(f"n{r.randrange(120)}", r.choice(["hub", f"m{r.randrange(60)}"])) for _ in range(120)]
    seeds = [(i, "hub" if i % 2 else f"n{r.randrange(120)}") for i in range(40)]
    e = spark.createDataFrame([(s, "r", d) for s, d in edges], "src string, rel string, dst string")
    got = graph.neighborhood(spark.createDataFrame(seeds, "entity int, node string"), e, 3).collect()
    assert {(x.entity, x.node): x.hop for x in got} == walk(seeds, edges, 3) and len(got) == len(walk(seeds, edges, 3))


def test_a_hub_is_in_no_task_alone(spark, monkeypatch):
    """Joined rows per (node, block, slice): no more than a block times a slice, whatever the hub has."""
    monkeypatch.setattr(graph, "HUB", 50)
    edges = spark.range(2000).select(F.when(F.col("id") < 1000, "hub").otherwise(F.concat(F.lit("n"), "id")).alias("src"), F.col("id").cast("string").alias("dst"))
    hubs = graph._frequent(edges, "src", "_blocks")
    assert [tuple(x) for x in hubs.collect()] == [("hub", 20)]
    front = spark.range(1500).select(F.col("id").alias("entity"), F.lit("hub").alias("node"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = graph._one_step(front, edges, hubs)
        assert out.count() == 1500 * 1000
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert "_b" in plan and "_s" in plan and "CartesianProduct" not in plan
