"""Typed knowledge graph as two tables: nodes(id, type, ...) and edges(src, rel, dst, weight, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigweave.dims import checked_broadcast
from sigweave.functions import scores as S
from sigweave.functions.text import slug
from sigweave.session import cut

# Readings that mean "not there".
ABSENT = ["none", "absent", "no", "normal", "regular", "0", ""]


def hierarchy(sections: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """`section_of` edges to the parent (or chapter), and nodes for parents that have no section of their own."""
    up = F.when(F.col("parent") != "", F.col("parent")).otherwise(F.col("chapter"))
    h = sections.select(key, "num", up.alias("up"))
    edges = h.select(key, F.concat(F.lit("section:"), "num").alias("src"), F.concat(F.lit("section:"), "up").alias("dst"))
    gone = h.select(key, F.col("up").alias("num")).distinct().join(h.select(key, "num"), [key, "num"], "left_anti")
    kind = F.when(F.col("num").contains("."), "stub").otherwise("chapter")
    return edges, gone.select(key, F.concat(F.lit("section:"), "num").alias("node"), kind.alias("kind"))


# ---- building -----------------------------------------------------------------------------


def edge(src, rel: str, dst, weight=None):
    """An (src, rel, dst, weight) struct column; `weight` defaults to NULL."""
    w = F.lit(None).cast("double") if weight is None else weight.cast("double")
    return F.struct(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), w.alias("weight"))


def seed_graph(outcomes: DataFrame, features: DataFrame, regions: DataFrame, reported: DataFrame) -> DataFrame:
    """Typed edges from nested knowledge rows; every branch is a local explode, no exchange.

    outcomes(id, symptoms array, recs map<category, array>, questions array<struct<q, weight>>)
    features(id, kind, points_to map, values map<value, map<outcome, weight>>)
    regions(zone, organs text split on / and ,); reported(symptom, outcome, weight)
    Symptoms and questions get an inverse `evidence_for` edge (0.3; question weight, default 0.4).
    """
    oid = F.concat(F.lit("pattern:"), F.col("id").cast("string"))
    node = lambda kind, c: F.concat(F.lit(kind + ":"), slug(c))
    sym = F.flatten(F.transform("symptoms", lambda s: F.array(edge(oid, "has_symptom", node("symptom", s)), edge(node("symptom", s), "evidence_for", oid, F.lit(0.3)))))
    rec = F.flatten(F.transform(F.map_entries("recs"), lambda e: F.transform(e["value"], lambda x: edge(oid, "recommends", F.concat(F.lit("rec:"), e["key"], F.lit(":"), slug(x))))))
    w = lambda q: F.coalesce(q["weight"], F.lit(0.4))
    ask = F.flatten(F.transform("questions", lambda q: F.array(edge(oid, "probes", node("question", q["q"]), w(q)), edge(node("question", q["q"]), "evidence_for", oid, w(q)))))
    a = outcomes.select(F.explode(F.concat(sym, rec, ask)).alias("e"))

    fid = F.concat(F.lit("feature:"), F.col("id").cast("string"))
    val = lambda v: F.concat(F.lit("value:"), F.col("id").cast("string"), F.lit("="), v)
    to = lambda m, v: F.transform(F.map_entries(m), lambda e: edge(val(v), "points_to", F.concat(F.lit("pattern:"), e["key"]), e["value"]))
    graded = F.when(
        F.col("kind").isin("graded_value", "extra"),
        F.concat(F.array(edge(val(F.lit("present")), "is_value_of", fid)), to(F.col("points_to"), F.lit("present"))),
    ).otherwise(F.array().cast("array<struct<src:string,rel:string,dst:string,weight:double>>"))
    valued = F.flatten(F.transform(F.map_entries("values"), lambda e: F.concat(F.array(edge(val(e["key"]), "is_value_of", fid)), to(e["value"], e["key"]))))
    b = features.select(F.explode(F.concat(graded, valued)).alias("e"))

    organs = F.filter(F.transform(F.split(F.replace("organs", F.lit("/"), F.lit(",")), ","), lambda o: F.trim(o)), lambda o: o != "")
    c = regions.select(F.explode(F.transform(organs, lambda o: edge(F.concat(F.lit("region:"), "zone"), "maps_to", node("organ", o)))).alias("e"))
    d = reported.select(edge(node("symptom", F.col("symptom")), "evidence_for", F.concat(F.lit("pattern:"), "outcome"), F.col("weight")).alias("e"))
    return a.unionByName(b).unionByName(c).unionByName(d).select("e.*")


def evidence_edges(trip: DataFrame, book: str) -> tuple[DataFrame, DataFrame]:
    """Cited edges from resolved triplets, and the candidates kept aside (junk drops).

    `trip(tid, section, feature, value, outcome, polarity, status)`: a mapped triplet
    gives one weighted (0.5) edge with its citation and snippet id, and an
    `attested_in` edge to its section.
    """
    m = trip.filter("status = 'mapped'")
    val = F.concat(F.lit("value:"), "feature", F.lit("="), F.coalesce("value", F.lit("present")))
    cite = F.concat(F.lit(book + " §"), F.col("section").cast("string"))
    snip = F.concat(F.lit(f"snip:{book}:"), F.col("section").cast("string"), F.lit(":"), F.col("tid").cast("string"))
    rel = F.when(F.col("polarity") == "supports", "points_to").otherwise("argues_against")
    row = lambda r, dst, w, s: F.struct(val.alias("src"), r.alias("rel"), dst.alias("dst"), w.alias("weight"), cite.alias("source"), s.alias("snippet"))
    both = F.array(
        row(rel, F.concat(F.lit("pattern:"), "outcome"), F.lit(0.5), snip),
        row(F.lit("attested_in"), F.concat(F.lit(f"section:{book}:"), F.col("section").cast("string")), F.lit(None).cast("double"), F.lit(None).cast("string")),
    )
    return m.select(F.explode(both).alias("e")).select("e.*"), trip.filter("status = 'candidate'").select("tid", "section", "feature", "outcome")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Merge node rows `(id, ord, type, name, prop, prop_value, source)`: first name and type win,
    later property values overwrite, sources keep first-seen order.

    Sources and properties are made distinct by map-side combined aggregates before
    they are listed, so a node mentioned in most rows does not gather them all.
    """
    head = nodes.groupBy("id").agg(F.min_by(F.struct("type", "name"), F.struct("ord", "name", "type")).alias("h"))
    src = nodes.filter("source is not null and source <> ''").groupBy("id", "source").agg(F.min("ord").alias("o"))
    src = src.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "source"))), lambda s: s["source"]).alias("sources"))
    prop = nodes.filter("prop is not null").groupBy("id", "prop").agg(F.max_by("prop_value", F.struct("ord", "prop_value")).alias("v"))
    prop = prop.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "v")))).alias("props"))
    return head.join(src, "id", "left").join(prop, "id", "left").select("id", "h.type", "h.name", "sources", "props")


# ---- lookups and walks ----------------------------------------------------------------------


def edges_from(nodes: DataFrame, edges: DataFrame, rel: str) -> DataFrame:
    return nodes.select(F.col("id").alias("src")).join(edges.filter(F.col("rel") == rel), "src")


def edges_to(nodes: DataFrame, edges: DataFrame, rel: str) -> DataFrame:
    return nodes.select(F.col("id").alias("dst")).join(edges.filter(F.col("rel") == rel), "dst")


#: rows of a node up to which they are not split; beyond it at most SHARE nodes are
HUB, SHARE = 10_000, 1000
#: hash values of keys that are counted first
SLOTS = 1 << 16


def _frequent(rows: DataFrame, key: str, parts: str) -> DataFrame | None:
    """(key, parts) of the keys with more rows than HUB and than one SHARE-th of all: fewer than SHARE, so it is broadcast.

    Rows are counted per hash value first, which needs no shuffle of keys; only keys of frequent values are counted one by
    one. None if there is no such key.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("_slot")
    n = cut(rows.groupBy(slot).agg(F.count("*").alias("_n")))
    bound = max(HUB, -(-(n.agg(F.sum("_n")).first()[0] or 0) // SHARE))
    many = n.filter(F.col("_n") > bound).select("_slot")
    if many.isEmpty():
        return None
    often = rows.select(key, slot).join(F.broadcast(many), "_slot").groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > bound)
    often = cut(often.select(key, F.ceil(F.col("_n") / bound).cast("int").alias(parts)))
    return None if often.isEmpty() else F.broadcast(often)


def _meet(frontier: DataFrame, edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """(entity, src, ...) for every frontier row (entity, src) and edge (src, dst, ...) from there.

    Edges of a hub lie in numbered blocks, and only frontier rows at a hub are copied to its blocks; where many entities
    stand at one node, they are dealt into slices and its edges are copied to these. No task has more than a block and a slice.
    """
    crowds = _frequent(frontier, "src", "_slices")
    if crowds is None and hubs is None:
        return frontier.join(edges, "src")
    none = lambda d, c: d.withColumn(c, F.lit(None).cast("int"))
    both = lambda d: none(d, "_slices") if crowds is None else d.join(crowds, "src", "left")
    known = lambda d: none(both(d), "_blocks") if hubs is None else both(d).join(hubs, "src", "left")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    part = lambda c, n: F.coalesce(F.pmod(F.xxhash64(c), F.col(n)).cast("int"), F.lit(0))
    f = known(frontier).select("entity", "src", part("entity", "_slices").alias("_s"), numbers("_blocks").alias("_b"))
    e = known(edges).select(*edges.columns, part("dst", "_blocks").alias("_b"), numbers("_slices").alias("_s"))
    return f.join(e, ["src", "_b", "_s"]).drop("_b", "_s")


def _one_step(frontier: DataFrame, edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """(entity, node) one edge behind the frontier (entity, node), repeats included."""
    return _meet(frontier.select("entity", F.col("node").alias("src")), edges, hubs).select("entity", F.col("dst").alias("node"))


def neighborhood(seeds: DataFrame, edges: DataFrame, hops: int = 2, rels=None, directed: bool = True, nodes: DataFrame | None = None) -> DataFrame:
    """(entity, node, hop): nodes reached from each entity's seeds within `hops` edges.

    With `nodes(id)` given, seeds that are no nodes of the graph are left out.

    Only new nodes form the next frontier; the last hop needs no such test, since the
    final minimum over hops removes repeats. Hubs and crowds are split (`_meet`).
    Edges are read once per hop and not stored: store them first if they are dear.
    """
    e = edges.select("src", "dst") if rels is None else edges.filter(F.col("rel").isin(list(rels))).select("src", "dst")
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    hubs = _frequent(e, "src", "_blocks")
    if hubs is not None:  # an edge that is there many times would lie in one block as often; elsewhere repeats are few
        often = e.join(hubs.select("src"), "src", "left_semi").distinct()
        e = cut(e.join(hubs.select("src"), "src", "left_anti").unionByName(often))
    reached = seeds.select("entity", "node").distinct()
    if nodes is not None:
        reached = reached.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("entity", "node")
    reached = cut(reached.withColumn("hop", F.lit(0)))
    frontier = reached
    for h in range(1, hops + 1):
        step = _one_step(frontier, e, hubs)
        if h < hops:
            step = cut(step.distinct().join(reached.select("entity", "node"), ["entity", "node"], "left_anti"))
        frontier = step.withColumn("hop", F.lit(h))
        reached = reached.unionByName(frontier)
    return reached.groupBy("entity", "node").agg(F.min("hop").alias("hop"))


def induced(reached: DataFrame, edges: DataFrame, rels=None) -> DataFrame:
    """Edges whose two ends an entity has reached."""
    e = edges if rels is None else edges.filter(F.col("rel").isin(list(rels)))
    out = _meet(reached.select("entity", F.col("node").alias("src")), e, _frequent(e, "src", "_blocks"))
    return out.join(reached.select("entity", F.col("node").alias("dst")), ["entity", "dst"], "left_semi")


# ---- evidence ------------------------------------------------------------------------------


# Corroboration and distinctiveness constants.
CORROB, CORROB_CAP = 0.28, 0.8
IDF_W, IDF_MIN, IDF_MAX, IDF_TYPICAL = 0.55, 0.65, 1.55, 3.0
SIGNED = ["points_to", "argues_against"]


def count_outcomes(edges: DataFrame) -> int:
    """Distinct outcome nodes the edges end in."""
    return edges.filter(F.col("dst").startswith("pattern:")).select("dst").distinct().count()


def outcome_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of signed edges into outcomes; combines map-side."""
    return edges.filter(F.col("rel").isin(SIGNED) & F.col("dst").startswith("pattern:")).select("src", "dst").distinct()


def idf_mult(pairs: DataFrame, n_outcomes: int) -> DataFrame:
    """(src, df, idf): distinct outcomes per source and the bounded distinctiveness multiplier.

    `pairs(src, dst)` is distinct (see `outcome_pairs`).
    """
    df = pairs.groupBy("src").agg(F.count("*").alias("df"))
    p = F.lit(float(max(1, n_outcomes)))
    ref = F.log(F.lit(1.0) + p / IDF_TYPICAL)
    mult = F.lit(1.0) + IDF_W * (F.log(F.lit(1.0) + p / F.col("df")) - ref) / ref
    return df.select("src", "df", S.rnd(S.clip(mult, IDF_MIN, IDF_MAX), 9).alias("idf"))


def evidence_groups(edges: DataFrame, n_outcomes: int | None = None) -> DataFrame:
    """Per (src, outcome, rel): signed contribution (max weight + log-scaled corroboration) * idf, and citations.

    One map-side combined pass over the edges; everything after it works on one row
    per distinct pair, however often it is cited. `n_outcomes` defaults to the
    outcomes that are cited at all.
    """
    e = edges.filter(F.col("rel").isin(SIGNED) & F.col("dst").startswith("pattern:"))
    g = cut(e.groupBy("src", "dst", "rel").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("base"), F.count("*").alias("n")))
    p = count_outcomes(g) if n_outcomes is None else n_outcomes
    bonus = F.when(F.col("n") > 1, F.least(F.lit(CORROB_CAP), F.lit(CORROB) * F.log(F.col("n").cast("double")))).otherwise(F.lit(0.0))
    w = (F.col("base") + bonus) * F.col("idf")
    return g.join(idf_mult(outcome_pairs(g), p), "src").select(
        "src", F.substring_index("dst", ":", -1).alias("outcome"), "rel", "n", "base",
        S.rnd(F.when(F.col("rel") == "points_to", w).otherwise(-w), 9).alias("contribution"),
    )


def citations(edges: DataFrame, n: int = 3) -> DataFrame:
    """First n distinct citations per (src, outcome, rel) by weight; repeats are merged first."""
    e = edges.filter(F.col("rel").isin(SIGNED)).groupBy("src", "dst", "rel", "snippet", "source").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    rn = F.row_number().over(W.partitionBy("src", "dst", "rel").orderBy(F.desc("weight"), "source", "snippet"))
    return e.withColumn("cite_rank", rn).filter(F.col("cite_rank") <= n).select("src", F.substring_index("dst", ":", -1).alias("outcome"), "rel", "cite_rank", "source", "snippet", "weight")


#: entry nodes of a task that makes evidence lines
ENTRIES = 10_000


def evidence_list(entries: DataFrame, groups: DataFrame, edges: DataFrame, n: int = 6, weights: bool = False) -> DataFrame:
    """First n cited lines of every (entity, outcome): the largest contribution first, then the weight, supporting before opposing.

    Citations of one (source, outcome, relation) that repeat a snippet and source are one. Within such a group lines go by
    weight, so n per group are enough; `pos` counts from 1. The citation's weight comes along if asked for.

    Entities are dealt out first, a bounded number of entry nodes to a task, and the few cited lines go to them. A task makes
    many lines of each entry node, so tasks must not be cut by the size of the entries, which is small.
    """
    cited = checked_broadcast(cut(groups.join(citations(edges, n), ["src", "outcome", "rel"]).drop("n", "base")))
    seeds = cut(entries.filter("node is not null").select("entity", F.col("node").alias("src")).distinct())
    tasks = max(int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seeds.count() // ENTRIES))
    seeds = seeds.repartition(tasks, "entity")
    name = F.substring_index("src", ":", -1)
    lines = seeds.join(cited, "src").select(
        "entity", "outcome", F.substring_index(name, "=", 1).alias("feature"), F.when(name.contains("="), F.substring_index(name, "=", -1)).otherwise("").alias("value"),
        F.col("rel").alias("polarity"), "source", "snippet", "contribution", "weight", "src",
    )
    order = [F.abs("contribution").desc(), F.desc("weight"), F.col("polarity") == "argues_against", F.col("src"), F.col("source"), F.col("snippet")]
    pos = F.row_number().over(W.partitionBy("entity", "outcome").orderBy(*order))
    return lines.withColumn("pos", pos).filter(F.col("pos") <= n).drop("src", *([] if weights else ["weight"]))


# The words and marks of prompt lines, which must read as published.
AGAINST, SUPPORTS, NO_SOURCE = "argues AGAINST", "supports", "rule KB"
CARD_HEAD, CARD_SUPPORT, CARD_WEIGHT, CARD_SYMPTOMS = "PATTERN ", ") \u2014 support ", " (w=", "   often with: "


def prompt_lines(evidence: DataFrame) -> DataFrame:
    """(entity, outcome, pos, line): evidence as text lines, each with its source and snippet, and its weight where it is there."""
    tag = F.when(F.col("polarity") == "argues_against", AGAINST).otherwise(SUPPORTS)
    quote = F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit(' "'), "snippet", F.lit('"'))).otherwise("")
    weight = [F.lit(CARD_WEIGHT), S.fixed2(F.col("weight")), F.lit(")")] if "weight" in evidence.columns else []
    line = F.concat(F.lit("- "), "feature", F.lit("="), "value", F.lit(" "), tag, *weight, F.lit(" ["), F.coalesce("source", F.lit(NO_SOURCE)), F.lit("]"), quote)
    return evidence.select("entity", "outcome", "pos", line.alias("line"))


def prompt_cards(ranked: DataFrame, evidence: DataFrame, context: DataFrame, names: DataFrame | None = None, symptoms: int = 6) -> DataFrame:
    """(entity, outcome, card): one text per ranked outcome: its name and support, its evidence lines, what it often comes with.

    `ranked(entity, outcome, score)`; `evidence` as of `evidence_list` with weights, a few rows per outcome; `context(entity,
    outcome, kind, item)` with the kind `symptom`; `names(outcome, name)` for the heading, the outcome itself where there is none.
    """
    lines = prompt_lines(evidence).groupBy("entity", "outcome").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    item = F.row_number().over(W.partitionBy("entity", "outcome").orderBy("item"))
    seen = context.filter("kind = 'symptom'").select("entity", "outcome", "item").distinct().withColumn("n", item).filter(F.col("n") <= symptoms)
    seen = seen.groupBy("entity", "outcome").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]), ", ").alias("s"))
    r = ranked.select("entity", "outcome", "score").join(lines, ["entity", "outcome"], "left").join(seen, ["entity", "outcome"], "left")
    r = r.withColumn("name", F.lit(None).cast("string")) if names is None else r.join(names.select("outcome", "name"), "outcome", "left")
    head = F.concat(F.lit(CARD_HEAD), F.coalesce("name", "outcome"), F.lit(" ("), "outcome", F.lit(CARD_SUPPORT), S.fixed2(F.col("score")))
    body = F.transform(F.coalesce(F.col("l.line"), F.array().cast("array<string>")), lambda x: F.concat(F.lit("   "), x))
    tail = F.when(F.col("s").isNotNull(), F.array(F.concat(F.lit(CARD_SYMPTOMS), "s"))).otherwise(F.array().cast("array<string>"))
    return r.select("entity", "outcome", F.array_join(F.concat(F.array(head), body, tail), "\n").alias("card"))


def match_citations(matched: DataFrame, evidence: DataFrame, n: int = 3) -> DataFrame:
    """(entity, outcome, pos, feature, source): the first n citations of every match."""
    c = evidence.filter(F.col("pos") <= n).select("entity", "outcome", "pos", "feature", F.coalesce("source", F.lit(NO_SOURCE)).alias("source"))
    return matched.select("entity", "outcome").join(c, ["entity", "outcome"])


def walked_context(entries: DataFrame, ranked: DataFrame, edges: DataFrame, rels: Sequence[str], hops: int = 2) -> DataFrame:
    """(entity, outcome, kind, item): what an entity's ranked outcomes lead to, as far as the walk from its entries reached it.

    `edges(src, rel, dst)` holds the evidence and the context of outcomes; only edges in `rels` are walked.
    """
    e = cut(edges.select("src", "rel", "dst").distinct())
    seeds = entries.filter("node is not null").select("entity", "node").distinct()
    reached = neighborhood(seeds, e, hops, rels).select("entity", F.col("node").alias("dst"))
    out = e.filter(F.col("src").startswith("pattern:") & ~F.col("rel").isin(SIGNED)).select(F.substring_index("src", ":", -1).alias("outcome"), F.col("rel").alias("kind"), "dst")
    got = ranked.select("entity", "outcome").join(out, "outcome").join(reached, ["entity", "dst"], "left_semi")
    return got.select("entity", "outcome", "kind", F.substring_index("dst", ":", -1).alias("item"))


def resolve_entries(present: DataFrame, nodes: DataFrame, feature_alias=None, value_alias=None, binary=(), positive=None, absent=ABSENT) -> DataFrame:
    """(entity, feature, value, node): the exact value node, else its presence node, else the
    feature node; `node` NULL = missing. Absent readings are skipped.

    Candidates are three ranked strings per reading, matched by one equi join on the node id.
    """
    v = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    d = present.withColumn("_v", v).filter(~F.col("_v").isin(list(absent)))
    for f, ok in (positive or {}).items():
        d = d.filter((F.col("feature") != f) | F.col("_v").isin(list(ok)))
    fa = F.lit(None).cast("string")
    for a, b in (feature_alias or {}).items():
        fa = F.when(F.col("feature") == a, F.lit(b)).otherwise(fa)
    d = d.withColumn("_f", F.coalesce(fa, F.col("feature")))
    val = F.col("_v")
    for (f, a), b in (value_alias or {}).items():
        val = F.when((F.col("_f") == f) & (F.col("_v") == a), F.lit(b)).otherwise(val)
    d = d.withColumn("_w", F.when(F.col("_f").isin(list(binary) or [""]), F.lit("present")).otherwise(val))
    cand = F.array(F.concat(F.lit("value:"), "_f", F.lit("="), "_w"), F.concat(F.lit("value:"), "_f", F.lit("=present")), F.concat(F.lit("feature:"), "_f"))
    c = d.select("entity", "feature", "value", F.posexplode(cand).alias("rank", "id"))
    hit = c.join(nodes.select("id").withColumn("_h", F.lit(1)), "id", "left")
    return hit.groupBy("entity", "feature", "value").agg(F.min_by("id", F.when(F.col("_h") == 1, F.col("rank"))).alias("node"))


def rank_evidence(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(entity, outcome, score, n_cites) summed over an entity's distinct entry nodes."""
    e = entries.filter("node is not null").select("entity", F.col("node").alias("src")).distinct()
    s = e.join(groups, "src").groupBy("entity", "outcome").agg(S.rnd(F.sum("contribution"), 6).alias("score"), F.sum("n").alias("n_cites"))
    rn = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("score"), "outcome"))
    return s.withColumn("rank", rn)


def match_fallback(ranked: DataFrame, k: int = 3, full: float = 5.0) -> DataFrame:
    """Deterministic matcher: the first k outcomes, those with a positive score kept; confidence min(1, score / 5)."""
    m = ranked.filter((F.col("rank") <= k) & (F.col("score") > 0))
    return m.select("entity", "outcome", "rank", S.rnd(F.least(F.lit(1.0), F.col("score") / full), 6).alias("confidence"), "score", "n_cites")


def retrieve(entries: DataFrame, ranked: DataFrame, context: DataFrame, evidence: DataFrame) -> DataFrame:
    """One record per entity: entry nodes, missing readings, ranked outcomes, their context and the snippets of their evidence.

    `context` comes from `walked_context`, `evidence` from `evidence_list`; lists are bounded by outcomes and lines per outcome.
    """
    s = evidence.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("snippet")), ",").alias("snippets"))
    e = entries.groupBy("entity").agg(
        F.array_join(F.array_sort(F.collect_set("node")), ",").alias("entries"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("node").isNull(), F.concat_ws("=", "feature", "value")))), ",").alias("missing"),
    )
    r = ranked.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "outcome"))), lambda x: x["outcome"]), ",").alias("outcomes"))
    c = context.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "item"))), ",").alias("context"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = e.join(r, "entity", "left").join(c, "entity", "left").join(s, "entity", "left")
    return rows.select("entity", "entries", "missing", blank("outcomes"), blank("context"), blank("snippets"))


# ---- recalibration, parity, statistics ----------------------------------------------------------


def citation_freq(edges: DataFrame) -> DataFrame:
    return edges.filter("rel = 'points_to' and snippet is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


def recalibrate(votes: DataFrame, freq: DataFrame, lam: float = 0.35) -> DataFrame:
    """Blend vote shares with citation shares per (feature, value), magnitude preserved; no citations = unchanged."""
    f = freq.select(F.col("src"), F.substring_index("dst", ":", -1).alias("outcome"), "n")
    v = votes.withColumn("src", F.concat(F.lit("value:"), "feature", F.lit("="), "value"))
    per = W.partitionBy("feature", "value")
    j = v.join(f, ["src", "outcome"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    base, cites = F.sum("weight").over(per), F.sum("n").over(per)
    share = F.lit(1 - lam) * F.col("weight") / base + F.lit(lam) * F.col("n") / F.nullif(cites, F.lit(0))
    return j.select("feature", "value", "outcome", S.rnd(F.when(cites == 0, F.col("weight")).otherwise(base * share), 6).alias("weight"), (cites > 0).alias("touched"))


def parity(expected: DataFrame, edges: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Expected edges with no actual edge of (nearly) the same weight; NULL weight = any."""
    e, a = expected.alias("e"), edges.alias("a")
    same = (F.col("e.src") == F.col("a.src")) & (F.col("e.rel") == F.col("a.rel")) & (F.col("e.dst") == F.col("a.dst"))
    close = F.col("e.weight").isNull() | (F.abs(F.coalesce(F.col("a.weight"), F.lit(0.0)) - F.col("e.weight")) < tol)
    return e.join(a, same & close, "left_anti")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    return n.unionByName(edges.groupBy(F.col("rel").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge")))


# ---- refinement ---------------------------------------------------------------------------------


def select_questions(ranked: DataFrame, probes: DataFrame, fallback: DataFrame, k: int = 3) -> DataFrame:
    """Questions that best separate the top-2 outcomes.

    value = weight * 4q(1-q) with q the lead's share of the two confidences. The best
    question of each target comes first, then the best remaining, texts unique.
    Outcomes without probes fall back to the lead's own list. Per entity the list is
    bounded by the probes of two outcomes, folded in order.
    """
    w = W.partitionBy("entity").orderBy("rank")
    top = ranked.filter("outcome <> 'balanced'").withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    pair = top.groupBy("entity").agg(
        F.max(F.when(F.col("_r") == 1, F.col("confidence"))).alias("pa"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("confidence"))), F.lit(0.0)).alias("pb"),
        F.max(F.when(F.col("_r") == 1, F.col("outcome"))).alias("lead"), F.count("*").alias("n_cand"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "outcome"))), lambda s: s["outcome"]), "|").alias("candidates"),
    )
    s = F.col("pa") + F.col("pb")
    q = F.col("pa") / F.nullif(s, F.lit(0.0))
    pair = pair.withColumn("contest", F.when(s <= 0, F.lit(1.0)).otherwise(4.0 * q * (1.0 - q)))
    items = top.select("entity", "outcome", "_r").join(probes, "outcome").join(pair.select("entity", "contest"), "entity")
    item = F.struct((-S.rnd(F.col("weight") * F.col("contest"), 6)).alias("v"), F.col("_r"), F.col("question").alias("q"), F.col("outcome").alias("t"), F.col("weight").alias("w"))
    per = items.groupBy("entity").agg(F.array_sort(F.collect_list(item)).alias("items"))
    d = pair.join(per, "entity", "left")
    kind = "array<struct<v:double,_r:int,q:string,t:string,w:double>>"
    empty = F.array().cast(kind)
    first = F.aggregate(
        F.coalesce("items", empty), empty,
        lambda acc, x: F.when((F.size(acc) >= F.least(F.lit(k), F.col("n_cand"))) | F.exists(acc, lambda p: (p["t"] == x["t"]) | (p["q"] == x["q"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    filled = F.aggregate(
        F.coalesce("items", empty), F.col("first"),
        lambda acc, x: F.when((F.size(acc) >= k) | F.exists(acc, lambda p: p["q"] == x["q"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    d = d.withColumn("first", first).withColumn("picked", filled)
    got = d.select("entity", "candidates", F.posexplode("picked").alias("pos", "x")).select(
        "entity", "candidates", (F.col("pos") + 1).alias("pos"), F.col("x.q").alias("question"), F.col("x.t").alias("target"), (-F.col("x.v")).alias("value")
    )
    spare = d.filter(F.size("picked") == 0).join(fallback.withColumnRenamed("outcome", "lead"), "lead").select(
        "entity", "candidates", "pos", "question", F.col("lead").alias("target"), F.lit(None).cast("double").alias("value")
    )
    return got.unionByName(spare)


def rescore(ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """Fold yes/no answers into the confidences and re-rank, balanced last; `delta` logs the change.

    `answers(entity, outcome, weight, yes)`; answers for outcomes not ranked are ignored.
    """
    ev = answers.groupBy("entity", "outcome").agg(F.sum(F.when(F.col("yes"), F.col("weight")).otherwise(-F.col("weight"))).alias("ev"))
    j = ranked.join(ev, ["entity", "outcome"], "left")
    new = S.rnd(S.logodds_update(F.col("confidence"), F.coalesce("ev", F.lit(0.0))), 6)
    j = j.withColumn("new", new)
    rn = F.row_number().over(W.partitionBy("entity").orderBy((F.col("outcome") == "balanced"), F.desc("new"), "outcome"))
    return j.select("entity", "outcome", F.col("new").alias("confidence"), S.rnd(F.col("new") - F.col("confidence"), 6).alias("delta"), rn.alias("rank"))
