"""Knowledge-graph, evidence, blending and refinement queries.

The star schema is read as a typed graph; line items act as citations linking
behaviour values to outcomes; conversation turns act as answers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.dims import Dim, checked_broadcast
from sigweave.functions import scores as S
from sigweave.operators import cases
from sigweave.operators import corpus as C
from sigweave.operators import graph as G
from sigweave.operators import inference as I
from sigweave.operators import report
from sigweave.plans import behaviour as B
from sigweave.plans import kb
from sigweave.plans import texts as T
from sigweave.plans.base import query, r, with_
from sigweave.session import cut, table


# ---- the star schema as a graph ---------------------------------------------------------------


def _nid(kind: str, col: str):
    return F.concat(F.lit(kind + ":"), F.col(col).cast("string"))


def star_nodes(spark, sf) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    one = lambda df, kind, k, name: df.select(_nid(kind, k).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"))
    return reduce(
        DataFrame.unionByName,
        [
            one(t("customer"), "customer", "c_custkey", "c_name"),
            one(t("nation"), "nation", "n_nationkey", "n_name"),
            one(t("region"), "region", "r_regionkey", "r_name"),
            one(t("supplier"), "supplier", "s_suppkey", "s_name"),
            one(t("part"), "part", "p_partkey", "p_name"),
            one(t("orders"), "order", "o_orderkey", "o_orderstatus"),
        ],
    )


def star_edges(spark, sf) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    one = lambda df, a, rel, b, w: df.select(a.alias("src"), F.lit(rel).alias("rel"), b.alias("dst"), w.cast("double").alias("weight"))
    null = F.lit(None)
    return reduce(
        DataFrame.unionByName,
        [
            one(t("orders"), _nid("order", "o_orderkey"), "placed_by", _nid("customer", "o_custkey"), null),
            one(t("customer"), _nid("customer", "c_custkey"), "is_in", _nid("nation", "c_nationkey"), null),
            one(t("supplier"), _nid("supplier", "s_suppkey"), "is_in", _nid("nation", "s_nationkey"), null),
            one(t("nation"), _nid("nation", "n_nationkey"), "part_of", _nid("region", "n_regionkey"), null),
            one(t("lineitem"), _nid("order", "l_orderkey"), "contains", _nid("part", "l_partkey"), F.col("l_quantity") / 50),
        ],
    )


C_NODES = """nodes AS (SELECT 'customer:' || c_custkey AS id, 'customer' AS type, c_name AS name FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
 UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name FROM region UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
 UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderstatus FROM orders)"""
C_EDGES = """edges AS (SELECT 'order:' || o_orderkey AS src, 'placed_by' AS rel, 'customer:' || o_custkey AS dst, NULL::DOUBLE AS weight FROM orders
 UNION ALL SELECT 'customer:' || c_custkey, 'is_in', 'nation:' || c_nationkey, NULL FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'is_in', 'nation:' || s_nationkey, NULL FROM supplier
 UNION ALL SELECT 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey, NULL FROM nation UNION ALL SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey, l_quantity/50 FROM lineitem)"""


@query("a33_graph_stats", with_([C_NODES, C_EDGES], "SELECT 'node' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY 2"))
def a33(spark, sf):
    return G.graph_stats(star_nodes(spark, sf), star_edges(spark, sf))


@query("g5_lookups", with_([C_NODES, C_EDGES], """SELECT 'from' AS side, e.src AS node, e.dst AS other FROM nodes n JOIN edges e ON e.src = n.id WHERE n.type = 'supplier' AND e.rel = 'is_in'
 UNION ALL SELECT 'to', e.dst, e.src FROM nodes n JOIN edges e ON e.dst = n.id WHERE n.type = 'region' AND e.rel = 'part_of'"""))
def g5(spark, sf):
    n, e = star_nodes(spark, sf), star_edges(spark, sf)
    a = G.edges_from(n.filter("type = 'supplier'"), e, "is_in").select(F.lit("from").alias("side"), F.col("src").alias("node"), F.col("dst").alias("other"))
    b = G.edges_to(n.filter("type = 'region'"), e, "part_of").select(F.lit("to").alias("side"), F.col("dst").alias("node"), F.col("src").alias("other"))
    return a.unionByName(b)


C_REACH = """seed AS (SELECT o_orderkey AS entity, 'order:' || o_orderkey AS node FROM orders),
h1 AS (SELECT DISTINCT entity, dst AS node FROM seed JOIN edges ON src = node), h2 AS (SELECT DISTINCT entity, dst AS node FROM h1 JOIN edges ON src = node),
reached AS (SELECT entity, node, min(hop) AS hop FROM (SELECT entity, node, 0 AS hop FROM seed UNION ALL SELECT entity, node, 1 FROM h1 UNION ALL SELECT entity, node, 2 FROM h2) GROUP BY 1, 2)"""


def order_seeds(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), _nid("order", "o_orderkey").alias("node"))


def reach(spark, sf) -> DataFrame:
    return G.neighborhood(order_seeds(spark, sf), star_edges(spark, sf), hops=2)


@query("g6_neighborhood", with_([C_EDGES, C_REACH], "SELECT entity, node, hop FROM reached"))
def g6(spark, sf):
    return reach(spark, sf)


@query("g7_induced", with_([C_EDGES.replace("edges AS (", "edges AS MATERIALIZED ("), C_REACH.replace("reached AS (", "reached AS MATERIALIZED (")], "SELECT entity, src, rel, dst FROM (SELECT a.entity, e.src, e.rel, e.dst FROM reached a JOIN edges e ON e.src = a.node WHERE e.rel <> 'contains') SEMI JOIN (SELECT entity, node AS dst FROM reached) USING (entity, dst)"))
def g7(spark, sf):
    edges = star_edges(spark, sf)
    walk = cut(G.neighborhood(order_seeds(spark, sf), edges, hops=2))
    rels = ["placed_by", "is_in", "part_of"]  # stored apart, few beside all edges
    return G.induced(walk, cut(edges.filter(F.col("rel").isin(rels)))).select("entity", "src", "rel", "dst")


@query("u5_id_diff", "SELECT 'customer:' || c_custkey AS id FROM customer EXCEPT SELECT 'customer:' || o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u5(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(_nid("customer", "o_custkey").alias("id"))
    return table(spark, sf, "customer").select(_nid("customer", "c_custkey").alias("id")).subtract(o)


# ---- building from nested knowledge ------------------------------------------------------------


SLUG = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[ \-_/]+', '-', 'g'), '[^\p{{L}}\p{{N}}\-]', '', 'g'), '-+', '-', 'g'), '-')"
C_SEED = f"""sy AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS s FROM part),
qs AS (SELECT p_partkey, p_name || ' size ' || p_size || '?' AS q, CASE WHEN p_size > 40 THEN 0.4 ELSE p_size/50 END::DOUBLE AS w FROM part),
rg AS (SELECT c_name AS zone, trim(unnest(string_split(replace(c_mktsegment || '/nation ' || c_nationkey || ', ,x', '/', ','), ','))) AS organ FROM customer),
seeded AS (SELECT 'pattern:' || p_partkey AS src, 'has_symptom' AS rel, 'symptom:' || {SLUG.format('s')} AS dst, NULL::DOUBLE AS weight FROM sy
 UNION ALL SELECT 'symptom:' || {SLUG.format('s')}, 'evidence_for', 'pattern:' || p_partkey, 0.3 FROM sy
 UNION ALL SELECT 'pattern:' || p_partkey, 'recommends', 'rec:diet:' || {SLUG.format('p_type')}, NULL FROM part
 UNION ALL SELECT 'pattern:' || p_partkey, 'recommends', 'rec:lifestyle:' || {SLUG.format('p_brand')}, NULL FROM part
 UNION ALL SELECT 'pattern:' || p_partkey, 'probes', 'question:' || {SLUG.format('q')}, w FROM qs
 UNION ALL SELECT 'question:' || {SLUG.format('q')}, 'evidence_for', 'pattern:' || p_partkey, w FROM qs
 UNION ALL SELECT 'value:' || s_suppkey || '=present', 'is_value_of', 'feature:' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 2 = 0
 UNION ALL SELECT 'value:' || s_suppkey || '=present', 'points_to', 'pattern:' || s_nationkey, s_acctbal/10000 FROM supplier WHERE s_suppkey % 2 = 0
 UNION ALL SELECT 'value:' || s_suppkey || '=rich', 'is_value_of', 'feature:' || s_suppkey, NULL FROM supplier
 UNION ALL SELECT 'value:' || s_suppkey || '=rich', 'points_to', 'pattern:' || (s_nationkey + 100), 0.5 FROM supplier
 UNION ALL SELECT 'region:' || zone, 'maps_to', 'organ:' || {SLUG.format('organ')}, NULL FROM rg WHERE organ <> ''
 UNION ALL SELECT 'symptom:' || {SLUG.format("'late ' || o_orderpriority")}, 'evidence_for', 'pattern:' || o_custkey, 0.2 FROM orders WHERE o_orderstatus = 'P')"""


def seeded(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    ask = F.struct(F.concat("p_name", F.lit(" size "), F.col("p_size").cast("string"), F.lit("?")).alias("q"), F.when(F.col("p_size") <= 40, F.col("p_size") / 50).alias("weight"))
    outcomes = p.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("symptoms"), F.create_map(F.lit("diet"), F.array("p_type"), F.lit("lifestyle"), F.array("p_brand")).alias("recs"), F.array(ask).alias("questions"))
    s = table(spark, sf, "supplier")
    nat = lambda x: F.col("s_nationkey") + x
    features = s.select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "graded_value").otherwise("categorical").alias("kind"),
        F.create_map(nat(0).cast("string"), F.col("s_acctbal") / 10000).alias("points_to"),
        F.create_map(F.lit("rich"), F.create_map(nat(100).cast("string"), F.lit(0.5))).alias("values"),
    )
    c = table(spark, sf, "customer")
    regions = c.select(F.col("c_name").alias("zone"), F.concat("c_mktsegment", F.lit("/nation "), F.col("c_nationkey").cast("string"), F.lit(", ,x")).alias("organs"))
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    reported = o.select(F.concat(F.lit("late "), "o_orderpriority").alias("symptom"), F.col("o_custkey").cast("string").alias("outcome"), F.lit(0.2).alias("weight"))
    return G.seed_graph(outcomes, features, regions, reported)


@query("g1_seed_graph", with_([C_SEED], f"SELECT src, rel, dst, {r('weight')} AS weight FROM seeded"))
def g1(spark, sf):
    return seeded(spark, sf).withColumn("weight", S.rnd(F.col("weight"), 6))


@query("j14_parity", with_([C_SEED], "SELECT src, rel, dst FROM seeded WHERE rel = 'probes' AND weight > 0.7 UNION ALL SELECT src, rel, dst FROM seeded WHERE rel = 'maps_to' AND dst = 'organ:x'"))
def j14(spark, sf):
    e = seeded(spark, sf)
    drift = F.when((F.col("rel") == "probes") & (F.col("weight") > 0.7), F.col("weight") + 1e-6).otherwise(F.col("weight"))
    actual = e.filter("not (rel = 'maps_to' and dst = 'organ:x')").withColumn("weight", drift)
    return G.parity(e, actual).select("src", "rel", "dst")


def part_triplets(spark, sf) -> DataFrame:
    t = C.resolve_terms(T.triplets(spark, sf), T.FEATURE_KEYS, T.OUTCOME_KEYS, T.F_ALIAS, T.O_ALIAS, T.HIDDEN)
    sec = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("section"))
    return t.join(sec, "p_partkey").withColumnRenamed("p_partkey", "tid").withColumn("polarity", F.when(F.col("tid") % 3 == 0, "against").otherwise("supports"))


from sigweave.plans.base import ORACLES  # noqa: E402

_F3 = ORACLES["f3_resolve_terms"]


@query("g3_evidence_edges", f"""WITH res AS ({_F3}), t AS (SELECT res.*, p_size AS section FROM res JOIN part USING (p_partkey)), m AS (SELECT *, 'value:' || feature || '=' || coalesce(value, 'present') AS v FROM t WHERE status = 'mapped')
 SELECT v AS src, CASE WHEN p_partkey % 3 = 0 THEN 'argues_against' ELSE 'points_to' END AS rel, 'pattern:' || outcome AS dst, 0.5::DOUBLE AS weight, 'book §' || section AS source, 'snip:book:' || section || ':' || p_partkey AS snippet FROM m
 UNION ALL SELECT v, 'attested_in', 'section:book:' || section, NULL, 'book §' || section, NULL FROM m
 UNION ALL SELECT coalesce(feature, ''), 'candidate', coalesce(outcome, ''), NULL, section::VARCHAR, NULL FROM t WHERE status = 'candidate'""")
def g3(spark, sf):
    edges, cand = G.evidence_edges(part_triplets(spark, sf), "book")
    null = lambda t: F.lit(None).cast(t)
    c = cand.select(F.coalesce("feature", F.lit("")).alias("src"), F.lit("candidate").alias("rel"), F.coalesce("outcome", F.lit("")).alias("dst"), null("double").alias("weight"), F.col("section").cast("string").alias("source"), null("string").alias("snippet"))
    return edges.unionByName(c)


@query("g4_merge_nodes", """WITH n AS (SELECT 'part:' || l_partkey AS id, l_orderkey*10+l_linenumber AS ord, 'line' AS type, 'n' || l_suppkey AS name, l_returnflag AS prop, 'v' || l_quantity::INT AS pv, 'doc ' || (l_suppkey % 7) AS source FROM lineitem),
 h AS (SELECT id, type, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, name, type) AS rn FROM n) WHERE rn = 1),
 s AS (SELECT id, string_agg(source, ',' ORDER BY o, source) AS sources FROM (SELECT id, source, min(ord) AS o FROM n GROUP BY 1, 2) GROUP BY 1),
 p AS (SELECT id, string_agg(prop || '=' || pv, ',' ORDER BY prop) AS props FROM (SELECT id, prop, arg_max(pv, {'o': ord, 'v': pv}) AS pv FROM n GROUP BY 1, 2) GROUP BY 1)
 SELECT id, type, name, sources, props FROM h JOIN s USING (id) JOIN p USING (id)""")
def g4(spark, sf):
    li = table(spark, sf, "lineitem")
    n = li.select(
        _nid("part", "l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.lit("line").alias("type"), F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("name"),
        F.col("l_returnflag").alias("prop"), F.concat(F.lit("v"), F.col("l_quantity").cast("int").cast("string")).alias("prop_value"), F.concat(F.lit("doc "), (F.col("l_suppkey") % 7).cast("string")).alias("source"),
    )
    m = G.merge_nodes(n)
    props = F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return m.select("id", "type", "name", F.array_join("sources", ",").alias("sources"), props.alias("props"))


# ---- cited evidence for behaviour values ----------------------------------------------------------


def cited_edges(spark, sf) -> DataFrame:
    """Line items as citations. `signup` has no node, `view=mid` only its feature node."""
    li = table(spark, sf, "lineitem")
    band = F.when(F.col("l_quantity") < 17, "low").when(F.col("l_quantity") < 34, "mid").otherwise("high")
    k = F.col("l_suppkey") % 4
    src = (
        F.when(k == 0, F.concat(F.lit("value:click="), band))
        .when((k == 1) & (band == "mid"), F.lit("feature:view"))
        .when(k == 1, F.concat(F.lit("value:view="), band))
        .when(k == 2, F.lit("value:buy=present"))
        .otherwise(F.lit("value:error=present"))
    )
    outcome = F.get(F.array(*[F.lit(o) for o in kb.OUTCOMES]), (F.col("l_partkey") % 5).cast("int"))
    # The fifth outcome is only cited by clicks, so breadths differ.
    outcome = F.when((outcome == "loyalty") & (k != 0), F.lit("growth")).otherwise(outcome)
    return li.select(
        src.alias("src"), F.when((F.col("l_returnflag") == "R") & outcome.isin("churn", "friction"), "argues_against").otherwise("points_to").alias("rel"), F.concat(F.lit("pattern:"), outcome).alias("dst"),
        S.rnd(F.col("l_discount") * (F.lit(3) + F.col("l_partkey") % 5), 2).alias("weight"), F.concat(F.lit("doc "), F.col("l_suppkey").cast("string")).alias("source"),
        F.concat(F.lit("s"), (F.col("l_orderkey") % 50).cast("string")).alias("snippet"),
    )


C_CITED = f"""ce0 AS (SELECT *, CASE WHEN l_quantity < 17 THEN 'low' WHEN l_quantity < 34 THEN 'mid' ELSE 'high' END AS band, l_suppkey % 4 AS k,
   CASE l_partkey % 5 WHEN 0 THEN 'churn' WHEN 1 THEN 'dormant' WHEN 2 THEN 'friction' WHEN 3 THEN 'growth' ELSE 'loyalty' END AS o FROM lineitem),
ce AS (SELECT CASE WHEN k = 0 THEN 'value:click=' || band WHEN k = 1 AND band = 'mid' THEN 'feature:view' WHEN k = 1 THEN 'value:view=' || band WHEN k = 2 THEN 'value:buy=present' ELSE 'value:error=present' END AS src,
  CASE WHEN l_returnflag = 'R' AND o IN ('churn','friction') THEN 'argues_against' ELSE 'points_to' END AS rel, 'pattern:' || CASE WHEN o = 'loyalty' AND k <> 0 THEN 'growth' ELSE o END AS dst, {r('l_discount*(3 + l_partkey % 5)', 2)} AS weight,
  'doc ' || l_suppkey AS source, 's' || (l_orderkey % 50) AS snippet FROM ce0)"""
C_GROUPS = f"""np AS (SELECT count(DISTINCT dst) AS p FROM ce),
idf AS (SELECT src, count(DISTINCT dst) AS df, {r('greatest(0.65::DOUBLE, least(1.55::DOUBLE, 1.0::DOUBLE + 0.55::DOUBLE*(ln(1.0::DOUBLE + p/count(DISTINCT dst)) - ln(1.0::DOUBLE + p/3.0::DOUBLE))/ln(1.0::DOUBLE + p/3.0::DOUBLE)))', 9)} AS idf FROM ce, np GROUP BY src, p),
g0 AS (SELECT src, dst, rel, max(weight) AS base, count(*) AS n FROM ce GROUP BY 1, 2, 3),
grp AS (SELECT src, substr(dst, 9) AS outcome, rel, n, base, {r("CASE WHEN rel = 'points_to' THEN 1 ELSE -1 END*(base + CASE WHEN n > 1 THEN least(0.8::DOUBLE, 0.28::DOUBLE*ln(n)) ELSE 0 END)*idf", 9)} AS contribution FROM g0 JOIN idf USING (src))"""
C_ENTRY = """cand AS (SELECT p.entity, p.feature, p.value, x.rank, x.id FROM (SELECT *, CASE feature WHEN 'purchase' THEN 'buy' ELSE feature END AS f, CASE WHEN feature = 'purchase' THEN 'present' WHEN feature = 'click' AND value = 'mid' THEN 'low' ELSE value END AS v FROM present) p,
   LATERAL (SELECT unnest([0, 1, 2]) AS rank, unnest(['value:' || f || '=' || v, 'value:' || f || '=present', 'feature:' || f]) AS id) x),
entry AS (SELECT entity, feature, value, arg_min(id, rank) FILTER (id IN (SELECT src FROM ce)) AS node FROM cand GROUP BY 1, 2, 3)"""
C_EVID = f"""evr AS (SELECT entity, outcome, {r('sum(contribution)')} AS score, sum(n) AS n_cites FROM (SELECT DISTINCT entity, node FROM entry WHERE node IS NOT NULL) e JOIN grp ON src = node GROUP BY 1, 2),
evk AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY score DESC, outcome) AS INT) AS rank FROM evr),
mat AS (SELECT entity, outcome, rank, {r('least(1.0::DOUBLE, score/5.0::DOUBLE)')} AS confidence, score, n_cites FROM evk WHERE rank <= 3 AND score > 0)"""
P_EVID = [*B.P_PRESENT, C_CITED, C_GROUPS, C_ENTRY, C_EVID]
P_BLEND = [*B.P_RANKED, C_CITED, C_GROUPS, C_ENTRY, C_EVID]


class Evidence(B.Behaviour):
    @B.cached_property
    def groups(self) -> DataFrame:
        e = cited_edges(self.spark, self.sf)
        return checked_broadcast(cut(G.evidence_groups(e)))

    @B.cached_property
    def entries(self) -> DataFrame:
        nodes = self.groups.select(F.col("src").alias("id")).distinct()
        return G.resolve_entries(self.present, nodes, {"purchase": "buy"}, {("click", "mid"): "low"}, binary=["buy"])

    @B.cached_property
    def evidence(self) -> DataFrame:
        return G.rank_evidence(self.entries, self.groups)

    @B.cached_property
    def lines(self) -> DataFrame:
        return G.evidence_list(self.entries, self.groups, cited_edges(self.spark, self.sf))

    @B.cached_property
    def matched(self) -> DataFrame:
        return cut(G.match_fallback(self.evidence))

    @B.cached_property
    def blended(self) -> DataFrame:
        return I.ensemble(self.ranked_once, self.matched)


@query("g8_idf_mult", with_([C_CITED, C_GROUPS], f"SELECT src, df, {r('idf')} AS idf FROM idf"))
def g8(spark, sf):
    pairs = cut(G.outcome_pairs(cited_edges(spark, sf)))
    return G.idf_mult(pairs, G.count_outcomes(pairs)).withColumn("idf", S.rnd(F.col("idf"), 6))


@query("g9_rank_evidence", with_(P_EVID, f"SELECT entity, outcome, score, n_cites, rank FROM evk"))
def g9(spark, sf):
    return Evidence(spark, sf).evidence


@query("g9_citations", with_([C_CITED], """, d AS (SELECT src, dst, rel, snippet, source, max(weight) AS weight FROM ce GROUP BY ALL)
 SELECT src, substr(dst, 9) AS outcome, rel, CAST(rn AS INT) AS cite_rank, source, snippet, weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, rel ORDER BY weight DESC, source, snippet) AS rn FROM d) WHERE rn <= 3"""))
def g9c(spark, sf):
    return G.citations(cited_edges(spark, sf))


@query("pr17_resolve_entries", with_([*B.P_PRESENT, C_CITED, C_ENTRY], "SELECT entity, feature, value, node FROM entry"))
def pr17(spark, sf):
    return Evidence(spark, sf).entries


@query("g11_match_fallback", with_(P_EVID, "SELECT entity, outcome, rank, confidence, n_cites FROM mat"))
def g11(spark, sf):
    return Evidence(spark, sf).matched.drop("score")


C_LIST = """cit0 AS (SELECT src, rel, dst, snippet, source, max(weight) AS weight FROM ce GROUP BY ALL),
cit AS (SELECT *, substr(dst, 9) AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, rel ORDER BY weight DESC, source, snippet) AS rn FROM cit0) WHERE rn <= 6),
evl AS (SELECT * FROM (SELECT entity, outcome, CASE WHEN contains(src, '=') THEN string_split(string_split(src, ':')[2], '=')[1] ELSE string_split(src, ':')[2] END AS feature,
   CASE WHEN contains(src, '=') THEN string_split(src, '=')[2] ELSE '' END AS value, rel AS polarity, source, snippet, contribution,
   CAST(row_number() OVER (PARTITION BY entity, outcome ORDER BY abs(contribution) DESC, weight DESC, rel = 'argues_against', src, source, snippet) AS INT) AS pos
  FROM (SELECT DISTINCT entity, node AS src FROM entry WHERE node IS NOT NULL) e JOIN grp USING (src) JOIN cit USING (src, outcome, rel)) WHERE pos <= 6)"""


@query("g9_evidence_list", with_([*P_EVID, C_LIST], "SELECT entity, outcome, pos, feature, value, polarity, source, snippet, contribution FROM evl"))
def g9_list(spark, sf):
    return Evidence(spark, sf).lines


@query("g9_prompt_lines", with_([*P_EVID, C_LIST], """SELECT entity, outcome, pos, '- ' || feature || '=' || value || CASE WHEN polarity = 'argues_against' THEN ' argues AGAINST [' ELSE ' supports [' END || source || '] "' || snippet || '"' AS line FROM evl"""))
def g9_prompt(spark, sf):
    return G.prompt_lines(Evidence(spark, sf).lines)


def fixed2_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 0 AND floor(abs({x})*100+0.5) > 0 THEN '-' ELSE '' END || CAST(floor(floor(abs({x})*100+0.5)/100) AS BIGINT) || '.' || lpad(CAST(CAST(floor(abs({x})*100+0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0'))"


@query("g9_prompt_cards", with_([*P_EVID, C_LIST.replace("source, snippet, contribution,", "source, snippet, contribution, weight,", 1)], f"""SELECT k.entity, k.outcome, 'PATTERN ' || k.outcome || ' (' || k.outcome || ') \u2014 support ' || {fixed2_sql('k.score')} || coalesce(l.t, '') || chr(10) || '   often with: ' || k.outcome || ' symptom 1, ' || k.outcome || ' symptom 2' AS card
  FROM evk k LEFT JOIN (SELECT entity, outcome, string_agg(chr(10) || '   - ' || feature || '=' || value || CASE WHEN polarity = 'argues_against' THEN ' argues AGAINST (w=' ELSE ' supports (w=' END || {fixed2_sql('weight')} || ') [' || source || '] "' || snippet || '"', '' ORDER BY pos) AS t FROM evl GROUP BY 1, 2) l USING (entity, outcome)"""))
def g9_cards(spark, sf):
    b = Evidence(spark, sf)
    cited = cited_edges(spark, sf)
    edges = cited.select("src", "rel", "dst").distinct().unionByName(CONTEXT.small(spark))
    return G.prompt_cards(b.evidence, G.evidence_list(b.entries, b.groups, cited, weights=True), G.walked_context(b.entries, b.evidence, edges, WALKED))


@query("g11_citations", with_([*P_EVID, C_LIST], "SELECT entity, outcome, pos, feature, source FROM evl JOIN mat USING (entity, outcome) WHERE pos <= 3"))
def g11_citations(spark, sf):
    b = Evidence(spark, sf)
    return G.match_citations(b.matched, b.lines)


#: what outcomes lead to; `mentions` is a relation that walks do not follow
CONTEXT = Dim(
    "ctx", [("src", "string"), ("rel", "string"), ("dst", "string")],
    [(f"pattern:{o}", rel, f"{rel}:{o} {rel} {i}") for o in kb.OUTCOMES for rel in ("symptom", "rec", "question", "mentions") for i in (1, 2)],
)
WALKED = ["points_to", "argues_against", "symptom", "rec", "question"]


@query("g10_retrieve", with_([*P_EVID, C_LIST, CONTEXT.cte()], """SELECT entity, coalesce(string_agg(DISTINCT node, ',' ORDER BY node), '') AS entries, coalesce(string_agg(feature || '=' || value, ',' ORDER BY feature || '=' || value) FILTER (node IS NULL), '') AS missing,
  coalesce((SELECT string_agg(outcome, ',' ORDER BY rank) FROM evk k WHERE k.entity = e.entity), '') AS outcomes,
  coalesce((SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT k.entity, c.rel || ':' || string_split(c.dst, ':')[2] AS x FROM evk k JOIN ctx c ON c.src = 'pattern:' || k.outcome WHERE c.rel <> 'mentions') q WHERE q.entity = e.entity), '') AS context,
  coalesce((SELECT string_agg(DISTINCT snippet, ',' ORDER BY snippet) FROM evl l WHERE l.entity = e.entity), '') AS snippets FROM entry e GROUP BY entity"""))
def g10(spark, sf):
    b = Evidence(spark, sf)
    edges = cited_edges(spark, sf).select("src", "rel", "dst").distinct().unionByName(CONTEXT.small(spark))
    return G.retrieve(b.entries, b.evidence, G.walked_context(b.entries, b.evidence, edges, WALKED), b.lines)


C_BLEND = f"""gate AS (SELECT k.entity, k.outcome <> 'balanced' AND k.entity IN (SELECT entity FROM mat) AS on_ FROM ranked k WHERE rank = 1),
bl0 AS (SELECT coalesce(p.entity, m.entity) AS entity, coalesce(p.outcome, m.outcome) AS outcome, p.confidence AS pc, m.confidence AS ec, coalesce(m.n_cites, 0) AS n_cites
  FROM (SELECT * FROM ranked WHERE outcome <> 'balanced' AND entity IN (SELECT entity FROM gate WHERE on_)) p FULL JOIN (SELECT * FROM mat WHERE entity IN (SELECT entity FROM gate WHERE on_)) m ON m.entity = p.entity AND m.outcome = p.outcome),
bl1 AS (SELECT entity, outcome, {r('coalesce(pc, 0.0)*0.8::DOUBLE + coalesce(ec, pc, 0.0)*0.2::DOUBLE')} AS confidence, CASE WHEN pc IS NULL THEN 'evidence-added' WHEN ec IS NULL THEN 'prior' ELSE 'ensemble' END AS origin, n_cites FROM bl0),
blend AS (SELECT entity, outcome, rank, confidence, origin, n_cites FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY confidence DESC, outcome) AS INT) AS rank FROM bl1) WHERE rank <= 3
  UNION ALL SELECT entity, outcome, rank, confidence, 'passthrough', 0 FROM ranked WHERE entity IN (SELECT entity FROM gate WHERE NOT on_))"""


@query("j11_ensemble", with_([*P_BLEND, C_BLEND], "SELECT entity, outcome, rank, confidence, origin, n_cites FROM blend"))
def j11(spark, sf):
    return Evidence(spark, sf).blended


C_SHADOW = """la AS (SELECT entity, list(outcome ORDER BY rank) AS l FROM ranked WHERE outcome <> 'balanced' GROUP BY 1), lb AS (SELECT entity, list(outcome ORDER BY rank) AS l FROM mat GROUP BY 1),
sh AS (SELECT e.entity, coalesce(la.l, []) AS a, coalesce(lb.l, []) AS b FROM ents e LEFT JOIN la USING (entity) LEFT JOIN lb USING (entity)),
srow AS (SELECT entity, len(list_intersect(a, b)) AS n_common, len(list_distinct(list_concat(a, b))) AS n_union, coalesce(a[1] = b[1], false) AS top1, CASE WHEN len(a)+len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))/len(list_distinct(list_concat(a, b))) END AS jaccard, len(a) = 0 AS abstain FROM sh)"""


@query("u4_list_overlap", with_([*P_BLEND, C_SHADOW], f"SELECT entity, n_common, n_union, {r('jaccard')} AS jaccard FROM srow"))
def u4(spark, sf):
    b = Evidence(spark, sf)
    return I.shadow_rows(b.ranked_once, b.matched, b.entities).select("entity", "n_common", "n_union", S.rnd(F.col("jaccard"), 6).alias("jaccard"))


@query("a24_shadow", with_([*P_BLEND, C_SHADOW, B.C_PROP], f""", rj AS (SELECT DISTINCT p.entity FROM prop p WHERE (p.entity, p.outcome) NOT IN (SELECT (entity, outcome) FROM ranked)
   UNION SELECT entity FROM (SELECT p.entity, p.outcome, count(q.entity) AS g FROM prop p LEFT JOIN present q ON q.entity = p.entity AND q.feature = p.feature GROUP BY 1, 2) WHERE g = 0)
 SELECT count(*) AS n, {r('avg(CAST(top1 AS INT))')} AS top1_agreement, {r('avg(jaccard)')} AS mean_jaccard, {r('avg(CAST(abstain AS INT))')} AS abstain_rate, {r('avg(CAST(entity IN (SELECT entity FROM rj) AS INT))')} AS reject_rate FROM srow"""))
def a24(spark, sf):
    b = Evidence(spark, sf)
    checked = I.validate_proposals(B.proposals(b), b.ranked_once, b.present)
    return I.shadow_summary(I.shadow_rows(b.ranked_once, b.matched, b.entities), checked)


@query("a25_ensemble_summary", with_([*P_BLEND, C_BLEND, *B.P_VALID], f""", val AS ({B.VALIDATED}), p AS (SELECT entity, arg_min(outcome, rank) AS ptop FROM ranked WHERE outcome <> 'balanced' GROUP BY 1),
 b AS (SELECT entity, arg_min(outcome, rank) AS btop, arg_min(CAST(n_cites > 0 AS INT), rank) AS lc, avg(CAST(n_cites > 0 AS INT)) AS cov, max(CAST(origin = 'evidence-added' AS INT)) AS added FROM blend GROUP BY 1)
 SELECT count(*) AS n, {r("avg(CAST(btop = coalesce(ptop, '') AS INT))")} AS stability, {r('avg(lc)')} AS lead_cited, {r('avg(cov)')} AS coverage, {r('avg(added)')} AS added_rate,
  {r("avg(CAST(entity IN (SELECT entity FROM val WHERE status <> 'kept') AS INT))")} AS reject_rate FROM b LEFT JOIN p USING (entity)"""))
def a25(spark, sf):
    b = Evidence(spark, sf)
    return I.ensemble_summary(b.ranked_once, b.blended, I.validate_proposals(B.proposals(b), b.ranked_once, b.present))


@query("a27_mapping_accuracy", with_([*B.P_RANKED], f""", acc AS (SELECT DISTINCT entity, CASE feature WHEN 'click' THEN 'growth' WHEN 'purchase' THEN 'loyalty' WHEN 'error' THEN 'friction' ELSE 'balanced' END AS outcome FROM sig WHERE severity > 0.5),
 t AS (SELECT k.*, count(*) OVER (PARTITION BY k.entity) AS c FROM ranked k), u AS (SELECT * FROM t WHERE NOT (outcome = 'balanced' AND c > 1 AND entity NOT IN (SELECT entity FROM acc WHERE outcome = 'balanced'))),
 v AS (SELECT entity, arg_min(outcome, rank) AS outcome FROM u GROUP BY 1) SELECT count(*) AS n, count(a.entity) AS n_ok, {r('count(a.entity)/count(*)')} AS accuracy FROM v LEFT JOIN acc a ON a.entity = v.entity AND a.outcome = v.outcome"""))
def a27m(spark, sf):
    b = B.Behaviour(spark, sf)
    f = F.col("feature")
    acc = b.sig.filter("severity > 0.5").select("entity", F.when(f == "click", "growth").when(f == "purchase", "loyalty").when(f == "error", "friction").otherwise("balanced").alias("outcome")).distinct()
    return cases.mapping_accuracy(b.ranked, acc)


@query("a27_expected_in_top", with_(P_EVID, """, ex AS (SELECT entity, 'growth' AS outcome FROM present WHERE feature = 'click' AND value = 'high') SELECT count(DISTINCT ex.entity) AS n, count(DISTINCT k.entity) AS n_ok FROM ex LEFT JOIN evk k ON k.entity = ex.entity AND k.outcome = ex.outcome AND k.rank <= 2"""))
def a27e(spark, sf):
    b = Evidence(spark, sf)
    exp = b.present.filter("feature = 'click' and value = 'high'").select("entity", F.lit("growth").alias("outcome"))
    return cases.expected_in_top(b.evidence, exp, 2)


@query("a28_citation_freq", with_([C_CITED], "SELECT src, dst, count(*) AS n FROM ce WHERE rel = 'points_to' GROUP BY 1, 2"))
def a28(spark, sf):
    return G.citation_freq(cited_edges(spark, sf))


@query("a29_recalibrate", with_([kb.VOTES.cte(), C_CITED], f""", fq AS (SELECT src, substr(dst, 9) AS outcome, count(*) AS n FROM ce WHERE rel = 'points_to' GROUP BY 1, 2),
 j AS (SELECT v.*, coalesce(f.n, 0) AS n FROM votes v LEFT JOIN fq f ON f.src = 'value:' || CASE WHEN v.feature = 'purchase' THEN 'buy' ELSE v.feature END || '=' || v.value AND f.outcome = v.outcome),
 w AS (SELECT *, sum(weight) OVER (PARTITION BY feature, value) AS b, sum(n) OVER (PARTITION BY feature, value) AS c FROM j)
 SELECT CASE WHEN feature = 'purchase' THEN 'buy' ELSE feature END AS feature, value, outcome, {r('CASE WHEN c = 0 THEN weight ELSE b*(0.65::DOUBLE*weight/b + 0.35::DOUBLE*n/c) END')} AS weight, c > 0 AS touched FROM w"""))
def a29(spark, sf):
    votes = kb.VOTES.small(spark).withColumn("feature", F.when(F.col("feature") == "purchase", "buy").otherwise(F.col("feature")))
    return G.recalibrate(votes, G.citation_freq(cited_edges(spark, sf)))


# ---- refinement ------------------------------------------------------------------------------------

PROBES = Dim(
    "probes",
    [("outcome", "string"), ("question", "string"), ("weight", "double")],
    [("growth", "more visits lately?", 0.6), ("growth", "new needs?", 0.5), ("growth", "shared with others?", 0.3), ("friction", "errors on checkout?", 0.7), ("friction", "new needs?", 0.65), ("churn", "shared with others?", 0.5), ("churn", "planning to leave?", 0.9)],
)
QUESTIONS = Dim("questions", [("outcome", "string"), ("pos", "int"), ("question", "string")], [(o, i, f"{o} question {i}") for o in kb.OUTCOMES for i in (1, 2)])
C_T5 = f"""tp AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY rank) AS rr FROM ranked WHERE outcome <> 'balanced'), t2 AS (SELECT * FROM tp WHERE rr <= 2),
pa AS (SELECT entity, max(confidence) FILTER (rr = 1) AS pa, coalesce(max(confidence) FILTER (rr = 2), 0.0) AS pb, max(outcome) FILTER (rr = 1) AS lead, count(*) AS nc, string_agg(outcome, '|' ORDER BY rr) AS candidates FROM t2 GROUP BY 1),
pc AS (SELECT *, CASE WHEN pa+pb <= 0 THEN 1.0 ELSE 4.0::DOUBLE*(pa/(pa+pb))*(1.0::DOUBLE-pa/(pa+pb)) END AS contest FROM pa),
it AS (SELECT t.entity, t.outcome AS t, t.rr, p.question AS q, {r('p.weight*c.contest')} AS v FROM t2 t JOIN probes p USING (outcome) JOIN pc c USING (entity)),
p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY v DESC, rr, q) AS n FROM it) WHERE n = 1),
p2 AS (SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY i.entity ORDER BY i.v DESC, i.rr, i.q) AS n FROM it i JOIN p1 USING (entity) WHERE i.t <> p1.t AND i.q <> p1.q) WHERE n = 1),
pk AS (SELECT entity, q FROM p1 UNION ALL SELECT entity, q FROM p2),
uq AS (SELECT *, row_number() OVER (PARTITION BY entity, q ORDER BY v DESC, rr) AS d FROM it i WHERE (entity, q) NOT IN (SELECT (entity, q) FROM pk)),
p3 AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY v DESC, rr, q) AS n FROM uq WHERE d = 1),
c2 AS (SELECT entity, count(*) AS k FROM pk GROUP BY 1),
al AS (SELECT entity, 1 AS pos, q, t, v FROM p1 UNION ALL SELECT entity, 2, q, t, v FROM p2 UNION ALL SELECT p3.entity, c2.k + p3.n, q, t, v FROM p3 JOIN c2 USING (entity) WHERE c2.k + p3.n <= 3)"""


@query("t5_select_questions", with_([*B.P_RANKED, PROBES.cte(), QUESTIONS.cte(), C_T5], """SELECT a.entity, c.candidates, CAST(a.pos AS INT) AS pos, a.q AS question, a.t AS target, a.v AS value FROM al a JOIN pc c USING (entity)
 UNION ALL SELECT c.entity, c.candidates, f.pos, f.question, c.lead, NULL FROM pc c JOIN questions f ON f.outcome = c.lead WHERE c.entity NOT IN (SELECT entity FROM it)"""))
def t5(spark, sf):
    return G.select_questions(B.Behaviour(spark, sf).ranked_once, PROBES.small(spark), QUESTIONS.small(spark))


def answers(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    bucket = (F.col("conv_id") + F.col("turn")) % 5
    return c.select(
        F.col("conv_id").alias("entity"), F.get(F.array(*[F.lit(o) for o in kb.OUTCOMES]), bucket.cast("int")).alias("outcome"), (((F.col("turn") % 5) + 1) / 10).alias("weight"), (F.length("text") % 2 == 0).alias("yes")
    )


C_ANS = """ans AS (SELECT conv_id AS entity, CASE (conv_id+turn) % 5 WHEN 0 THEN 'churn' WHEN 1 THEN 'dormant' WHEN 2 THEN 'friction' WHEN 3 THEN 'growth' ELSE 'loyalty' END AS outcome, ((turn % 5) + 1)/10 AS weight, length(text) % 2 = 0 AS yes FROM conversations),
av AS (SELECT entity, outcome, sum(CASE WHEN yes THEN weight ELSE -weight END) AS ev FROM ans GROUP BY 1, 2)"""


def lo_sql(c: str, ev: str) -> str:
    q = f"greatest(0.001::DOUBLE, least(0.999::DOUBLE, {c}))"
    return r(f"1.0::DOUBLE/(1.0::DOUBLE+exp(-(ln({q}/(1.0::DOUBLE-{q})) + 1.4::DOUBLE*{ev})))")


@query("f18_logodds_update", with_([C_ANS], f"SELECT entity, outcome, {lo_sql('(entity % 11)/10.0::DOUBLE', 'ev')} AS confidence FROM av"))
def f18(spark, sf):
    ev = answers(spark, sf).groupBy("entity", "outcome").agg(F.sum(F.when(F.col("yes"), F.col("weight")).otherwise(-F.col("weight"))).alias("ev"))
    return ev.select("entity", "outcome", S.rnd(S.logodds_update((F.col("entity") % 11) / 10.0, F.col("ev")), 6).alias("confidence"))


@query("g12_rescore", with_([*B.P_RANKED, C_ANS], f""", n AS (SELECT k.*, {lo_sql('k.confidence', 'coalesce(a.ev, 0.0)')} AS new FROM ranked k LEFT JOIN av a ON a.entity = k.entity AND a.outcome = k.outcome)
 SELECT entity, outcome, new AS confidence, {r('new - confidence')} AS delta, CAST(row_number() OVER (PARTITION BY entity ORDER BY outcome = 'balanced', new DESC, outcome) AS INT) AS rank FROM n"""))
def g12(spark, sf):
    return G.rescore(B.Behaviour(spark, sf).ranked, answers(spark, sf))


@query("pr15_assemble", with_(B.P_BOTH, """SELECT e.entity, (SELECT sum(n_obs) FROM sig s WHERE s.entity = e.entity) >= 5 AS accepted, (SELECT string_agg(outcome || '@' || rank, ',' ORDER BY rank) FROM ranked k WHERE k.entity = e.entity) AS outcomes,
  (SELECT string_agg(phrase, ',' ORDER BY pos) FROM found f WHERE f.entity = e.entity) AS phrases FROM ents e"""))
def pr15(spark, sf):
    b = B.Behaviour(spark, sf)
    quality = b.read.groupBy("entity").agg((F.sum("n_obs") >= 5).alias("accepted"))
    doc = report.assemble(b.ranked, b.found, quality)
    shape = "accepted boolean, outcomes array<struct<rank:int,outcome:string,confidence:double>>, findings array<struct<pos:int,phrase:string>>"
    d = doc.select("entity", F.from_json("result", shape).alias("r"))
    tag = F.transform("r.outcomes", lambda o: F.concat(o["outcome"], F.lit("@"), o["rank"].cast("string")))
    return d.select("entity", "r.accepted", F.array_join(tag, ",").alias("outcomes"), F.array_join(F.col("r.findings.phrase"), ",").alias("phrases"))
