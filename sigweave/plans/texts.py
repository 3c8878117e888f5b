"""Text, section, corpus and retrieval queries over `documents`, `pages`, `benchmark`, `conversations`, `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.functions import scores as S
from sigweave.functions import text as X
from sigweave.operators import corpus as C
from sigweave.operators import labels as L
from sigweave.operators import matching as M
from sigweave.operators import retrieval as R
from sigweave.plans.base import query, r, with_
from sigweave.session import scratch, table
from sigweave.sources import files as FS

STOP = "the of and to in is it for on as are by with that this an at be or from was".split()


def docs(spark, sf, *cols: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *cols)


# ---- sources bound to tables ----------------------------------------------------------------


@query("src1_scan_files", "SELECT 'r' || (o_custkey % 7) AS folder, count(*) AS n_rows, o_custkey % 7 < 4 AS has_pair FROM orders GROUP BY ALL")
def src1(spark, sf):
    """Two inventories of written folders; a part of the left one has a folder of the same name on the right."""
    out = scratch(spark, "inventory")
    o = table(spark, sf, "orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 7).cast("string")).alias("folder"), F.col("o_orderkey").cast("string").alias("value"))
    o.write.partitionBy("folder").text(f"{out}/left")
    o.filter("folder < 'r4'").write.partitionBy("folder").text(f"{out}/right")
    folder = F.regexp_extract("path", r"/folder=([^/]+)/", 1)
    left, right = (FS.scan_files(spark, f"{out}/{side}").withColumn("stem", folder) for side in ("left", "right"))
    pairs = FS.pair_files(left.select("stem", F.col("path")), right.groupBy("stem").agg(F.min("path").alias("path")))
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{out}/left").select(F.col("_metadata.file_path").alias("file"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    n = lines.groupBy(name(F.col("file")).alias("name"), F.regexp_extract("file", r"/folder=([^/]+)/", 1).alias("stem")).agg(F.count("*").alias("n"))
    j = pairs.withColumn("name", name(F.col("path"))).join(n, ["name", "stem"])
    return j.groupBy(F.col("stem").alias("folder"), "has_pair").agg(F.sum("n").alias("n_rows"))


@query("src4_read_boxes", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT doc_id, length(line) || '.0 0.5 0.5 0.1 0.1' AS line FROM l WHERE trim(line) <> '' UNION ALL SELECT doc_id, line FROM l WHERE trim(line) = '')
  SELECT CAST(CAST(string_split(trim(line), ' ')[1] AS DOUBLE) AS INT) AS class_id, count(*) AS n, count(DISTINCT doc_id % 5) AS n_parts FROM b WHERE trim(line) <> '' GROUP BY 1""")
def src4(spark, sf):
    line = F.explode(F.split("text", "\n"))
    d = docs(spark, sf, "text").select("doc_id", line.alias("line"))
    d = d.select("doc_id", F.when(F.trim("line") != "", F.concat(F.length("line").cast("string"), F.lit(".0 0.5 0.5 0.1 0.1"))).otherwise(F.col("line")).alias("line"))
    out = scratch(spark, "boxes")
    d.select((F.col("doc_id") % 5).alias("part"), F.col("line").alias("value")).write.partitionBy("part").text(out)
    part = F.regexp_extract("path", r"/part=([0-9]+)/", 1)
    return FS.read_boxes(spark, out).groupBy("class_id").agg(F.count("*").alias("n"), F.countDistinct(part).alias("n_parts"))


@query("src5_unnest_label_json", "SELECT event_id, CAST(user_id AS VARCHAR) AS id, 'k' AS feature, json_extract_string(props, '$.k') AS value FROM events WHERE user_id % 3 <> 0")
def src5(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "props")
    uid = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("_"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    j = e.select("event_id", F.concat(F.lit('{"'), uid, F.lit('": '), F.col("props"), F.lit("}")).alias("j"))
    return FS.unnest_label_json(j, "j", ["event_id"])


# ---- scalar text -----------------------------------------------------------------------------


@query("f1_slug", r"""SELECT p_partkey, substr(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_type || '_' || p_brand)), '[ \-_/]+', '-', 'g'), '[^\p{L}\p{N}\-]', '', 'g'), '-+', '-', 'g'), '-'), 1, 60) AS slug FROM part""")
def f1(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit("_"), "p_brand")).alias("slug"))


RAW_TERM_SQL = "'Other: <' || p_name || '> (' || p_type || ')  ' || p_brand || ' ,'"


@query("f2_clean_term", r"""SELECT p_partkey, t AS term, (t = '' OR contains(t, 'none') OR contains(t, 'n/a')) AS junk FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(ltrim(trim(regexp_replace(""" + RAW_TERM_SQL + r""", '(?i)^\s*other\s*:\s*', '')), '<>'), '\s*\(.*?\)\s*', ' ', 'g'), '\s+', ' ', 'g'))), '^[.,:;]+', ''), '[.,:;]+$', '') AS t FROM part)""")
def f2(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat(F.lit("Other: <"), "p_name", F.lit("> ("), "p_type", F.lit(")  "), "p_brand", F.lit(" ,"))
    t = X.clean_term(raw)
    return p.select("p_partkey", t.alias("term"), X.is_junk(t).alias("junk"))


FEATURE_KEYS = ["red widget", "blue bolt", "small ring"]
OUTCOME_KEYS = ["economy", "standard"]
F_ALIAS = {"large ring": ("small ring", "big"), "green bolt": ("blue bolt", "green")}
O_ALIAS = {"small": "economy", "brand#1": "standard", "promo": "standard"}
HIDDEN = ["plate", "cog"]


def triplets(spark, sf) -> DataFrame:
    """Raw triplets from parts: noisy feature and outcome strings with an optional value."""
    k = F.col("p_partkey")
    f = F.when(k % 7 == 0, F.concat(F.lit("other: "), "p_name")).when(k % 7 == 1, F.concat("p_name", F.lit(" (seen)"))).when(k % 7 == 2, F.lit("none")).when(k % 7 == 3, F.concat("p_name", F.lit(" in a very long free text that is not any sign"))).otherwise(F.col("p_name"))
    o = F.when(k % 5 == 0, F.concat_ws(" ", "p_brand", F.lit("kind"))).when(k % 5 == 1, F.concat(F.lit("<"), "p_type", F.lit(">"))).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", f.alias("feature"), F.when(k % 2 == 0, "mid").when(k % 3 == 0, "").alias("value"), o.alias("outcome"))


C_TRIP = """trip AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'other: ' || p_name WHEN 1 THEN p_name || ' (seen)' WHEN 2 THEN 'none' WHEN 3 THEN p_name || ' in a very long free text that is not any sign' ELSE p_name END AS feature,
  CASE WHEN p_partkey % 2 = 0 THEN 'mid' WHEN p_partkey % 3 = 0 THEN '' END AS value, CASE p_partkey % 5 WHEN 0 THEN p_brand || ' kind' WHEN 1 THEN '<' || p_type || '>' ELSE p_type END AS outcome FROM part)"""


@query("f3_resolve_terms", with_([C_TRIP], """, c AS (SELECT p_partkey, value, lower(CASE p_partkey % 7 WHEN 0 THEN substr(feature, 8) WHEN 1 THEN replace(feature, ' (seen)', '') ELSE feature END) AS f, lower(replace(replace(outcome, '<', ''), '>', '')) AS o FROM trip),
 s AS (SELECT *, CASE WHEN f = 'none' THEN 'junk' WHEN f IN ('red widget','blue bolt','small ring','large ring','green bolt') THEN 'mapped' WHEN contains(f, 'plate') OR contains(f, 'cog') THEN 'candidate' WHEN length(f) > 45 THEN 'junk' ELSE 'candidate' END AS fs,
   CASE WHEN o IN ('economy','standard','small','brand#1','promo') THEN 'mapped' WHEN contains(o, 'small') OR contains(o, 'brand#1') OR contains(o, 'promo') THEN 'mapped' ELSE 'candidate' END AS os FROM c)
 SELECT p_partkey, CASE WHEN fs = 'junk' THEN NULL WHEN f = 'large ring' THEN 'small ring' WHEN f = 'green bolt' THEN 'blue bolt' ELSE f END AS feature,
  CASE WHEN fs = 'junk' THEN NULL WHEN f IN ('red widget','blue bolt','small ring') THEN CASE WHEN value <> '' THEN value ELSE 'present' END WHEN f = 'large ring' THEN 'big' WHEN f = 'green bolt' THEN 'green' ELSE value END AS value,
  CASE WHEN o IN ('economy','standard') THEN o WHEN contains(o, 'small') THEN 'economy' WHEN contains(o, 'brand#1') OR contains(o, 'promo') THEN 'standard' ELSE o END AS outcome,
  CASE WHEN fs = 'junk' THEN 'junk' WHEN fs = 'candidate' OR os = 'candidate' THEN 'candidate' ELSE 'mapped' END AS status FROM s"""))
def f3(spark, sf):
    return C.resolve_terms(triplets(spark, sf), FEATURE_KEYS, OUTCOME_KEYS, F_ALIAS, O_ALIAS, HIDDEN)


@query("a31_review", with_([C_TRIP], r""", c AS (SELECT CASE p_partkey % 7 WHEN 1 THEN replace(feature, ' (seen)', '') ELSE feature END AS f, outcome AS o, feature FROM trip),
 k AS (SELECT *, CASE WHEN starts_with(feature, 'other:') OR length(feature) > 45 THEN 'junk' WHEN f IN ('red widget','blue bolt','small ring') AND o IN ('economy','standard') THEN 'ok' ELSE 'norm' END AS cls FROM c)
 SELECT 'class' AS kind, cls AS term, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'feature', f, count(*) FROM k WHERE cls <> 'ok' AND f NOT IN ('red widget','blue bolt','small ring') GROUP BY 2
 UNION ALL SELECT 'outcome', o, count(*) FROM k WHERE cls <> 'ok' AND o NOT IN ('economy','standard') GROUP BY 2"""))
def a31(spark, sf):
    tallies, unknown = C.review(triplets(spark, sf), FEATURE_KEYS, OUTCOME_KEYS)
    return tallies.select(F.lit("class").alias("kind"), F.col("cls").alias("term"), "n").unionByName(unknown)


NAMES = ["example", "track", "The"]
_P = "traditional texts"


def redact_sql(c: str) -> str:
    s = rf"regexp_replace({c}, '(?i)\*\*Grounding:\*\*[^\n]*\n?', '', 'g')"
    for pattern, by in X.ATTRIBUTIONS:
        s = f"regexp_replace({s}, '{pattern}', '{_P if by is None else by}', 'g')"
    s = rf"regexp_replace({s}, '(?i)\b(example|track|The)\b', '{_P}', 'g')"
    s = rf"regexp_replace({s}, '({_P})([\s,;·—-]+{_P})+', '\1', 'g')"
    s = rf"regexp_replace({s}, '[ \t]{{2,}}', ' ', 'g')"
    return rf"regexp_replace({s}, '^[ ·—\-,;]+|[ ·—\-,;]+$', '', 'g')"


@query("f4_redact", f"SELECT page_id, md5({redact_sql('html || chr(32) || url')}) AS h, length({redact_sql('html || chr(32) || url')}) AS n FROM pages")
def f4(spark, sf):
    t = X.redact(F.concat_ws(" ", "html", "url"), NAMES)
    return table(spark, sf, "pages").select("page_id", F.md5(t).alias("h"), F.length(t).alias("n"))


@query("pr14_strip_external", f"""SELECT page_id, {redact_sql("'see ' || url || ' p. 12 — '")} AS why, {redact_sql("'The example, ' || url")} AS finding, '' AS cite FROM pages""")
def pr14(spark, sf):
    from sigweave.operators.report import strip_external

    nested = F.struct(
        F.concat(F.lit("see "), "url", F.lit(" p. 12 — ")).alias("why"),
        F.array(F.concat(F.lit("The example, "), F.col("url"))).alias("findings"),
        F.array(F.col("url")).alias("citations"),
        F.col("url").alias("cite"),
    )
    d = table(spark, sf, "pages").select("page_id", nested.alias("result"))
    d = strip_external(d, "result", drop=["citations"], blank=["cite"], texts=["why"], text_lists=["findings"], names=NAMES)
    return d.select("page_id", "result.why", F.get("result.findings", F.lit(0)).alias("finding"), "result.cite")


@query("f8_clause", "SELECT doc_id, regexp_extract(text, '(the [a-z ,]*)', 1) AS clause FROM documents")
def f8(spark, sf):
    return docs(spark, sf, "text").select("doc_id", X.clause(F.col("text"), "the ", "a-z ,").alias("clause"))


LEXICON = [("ation", "growth"), ("eaux", "friction"), ("schen", "dormant"), ("ción", "loyalty"), ("the", "churn")]


@query("f9_parse_lexicon", "SELECT doc_id, CASE WHEN contains(t, 'ation') THEN 'growth' WHEN contains(t, 'eaux') THEN 'friction' WHEN contains(t, 'schen') THEN 'dormant' WHEN contains(t, 'ción') THEN 'loyalty' WHEN contains(t, 'the') THEN 'churn' END AS outcome FROM (SELECT doc_id, replace(replace(text, 'eauxa', ''), 'thei', '') AS t FROM documents)")
def f9(spark, sf):
    return docs(spark, sf, "text").select("doc_id", X.parse_lexicon(F.col("text"), LEXICON, ["eauxa", "thei"]).alias("outcome"))


@query("f10_fold_ws", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents")
def f10(spark, sf):
    return docs(spark, sf, "text").select("doc_id", F.md5(X.fold_ws(F.col("text"))).alias("h"))


@query("f11_extract_json", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events")
def f11(spark, sf):
    body = F.when(F.col("event_id") % 7 == 0, F.replace("props", F.lit("}"), F.lit("]}"))).otherwise(F.col("props"))
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("note\n"), body, F.lit("\nend")).alias("t"))
    return e.select("event_id", X.extract_json(F.col("t"), "k int").getField("k").alias("k"))


@query("f12_lookup_options", """SELECT conv_id, turn, CASE k WHEN 'A' THEN 'role ' || role WHEN 'B' THEN 'turn ' || turn ELSE k END AS answer FROM conversations, LATERAL (SELECT unnest(CASE WHEN turn % 2 = 0 THEN ['A', 'C'] ELSE ['B'] END) AS k)""")
def f12(spark, sf):
    c = table(spark, sf, "conversations")
    opts = F.concat(F.lit("A:role "), "role", F.lit(";B:turn "), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", F.explode(X.lookup_options(opts, F.when(F.col("turn") % 2 == 0, "A； C").otherwise("B"))).alias("answer"))


@query("f13_chunks", """SELECT 'part:' || p_partkey AS id, p_name || ' ''' || p_type || ''' (' || p_brand || '): size ' || p_size || '.' || CASE WHEN p_size > 25 THEN ' Traditionally stored apart.' ELSE '' END AS text FROM part
 UNION ALL SELECT 'region:' || r_regionkey, r_name || ' includes ' || (SELECT string_agg(n_name, ', ' ORDER BY n_name) FROM (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 4)) || '.' FROM region""")
def f13(spark, sf):
    from sigweave.operators.report import chunk_lists

    p = table(spark, sf, "part")
    size = F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit("."))
    tail = F.when(F.col("p_size") > 25, " Traditionally stored apart.").otherwise("")
    a = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.concat("p_name", F.lit(" '"), "p_type", F.lit("' ("), "p_brand", F.lit("): "), size, tail).alias("text"))
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", "n_name")
    b = chunk_lists(j, ["r_regionkey", "r_name"], "n_name", 4)
    b = b.select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"), F.concat("r_name", F.lit(" includes "), "items", F.lit(".")).alias("text"))
    return a.unionByName(b)


@query("f13_knowledge_chunks", """WITH f AS (SELECT p_partkey AS doc, p_name AS name, p_type AS type, p_brand AS brand, p_size AS size FROM part)
 SELECT doc, 'feature:' || name AS id, name || ' — when present: ' || type || '. In plain terms: ' || brand || '.' AS text, 'a; b' AS source FROM f WHERE size % 2 = 0
 UNION ALL SELECT doc, 'feature:' || name || '=low', name || ' ''low'' (' || type || '): size ' || size || CASE WHEN size % 3 = 0 THEN '' ELSE ' Traditionally associated with: ' || brand || '.' END, 'a; b' FROM f
 UNION ALL SELECT doc, 'extra:' || brand, brand || ': ' || type || '. ', 'a; b' FROM f
 UNION ALL SELECT doc, 'pattern:' || type, type || ' (' || brand || '): made' || CASE WHEN size > 25 THEN ' Often noticed: ' || name || ', ' || brand || '.' ELSE '' END || ' Modern view: new. Wellness notes: 1; 2; 3; 4.', 'book' FROM f
 UNION ALL SELECT doc, 'rule:r' || size, 'Combination reasoning: ' || name, brand FROM f WHERE size > 10
 UNION ALL SELECT doc, 'zone:tip', 'Part tip reflects ' || type || ': ' || name, 'map' FROM f""")
def f13_knowledge(spark, sf):
    from sigweave.sources.knowledge import KNOWLEDGE, knowledge_chunks

    st = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    p, size = table(spark, sf, "part"), F.col("p_size")
    c, none = F.col, F.lit(None).cast("string")
    low = st(tcm_term=c("p_type"), plain_gloss=F.concat(F.lit("size "), size.cast("string")), points_to=F.when(size % 3 != 0, F.create_map("p_brand", F.lit(0.5))))
    feature = st(label=none, kind=F.when(size % 2 == 0, "graded_value").otherwise("categorical"), present_tcm=c("p_type"), present_plain=c("p_brand"), values=F.create_map(F.lit("low"), low))
    advice = F.create_map(F.lit("diet"), F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.lit("lifestyle"), F.array(F.lit("4"), F.lit("5")))
    seen = F.when(size > 25, F.array("p_name", "p_brand"))
    outcome = st(tcm_name=none, plain_name=c("p_brand"), explanation=F.lit("made"), associated_symptoms=seen, recommendations=advice, modern_correlation=F.lit("new"))
    rule = st(id=F.concat(F.lit("r"), size.cast("string")), note=F.when(size > 10, c("p_name")), cite=c("p_brand"))
    nested = st(
        features=F.create_map(c("p_name"), feature), extra_features=F.create_map(c("p_brand"), st(present_tcm=c("p_type"))),
        patterns=F.create_map(c("p_type"), outcome, F.lit("balanced"), outcome), combination_rules=F.array(rule),
        regions=F.create_map(F.lit("tip"), st(organs=c("p_type"), note=c("p_name"))), sources=F.array(F.lit("a"), F.lit("b"), F.lit("c")),
    )
    d = p.select(c("p_partkey").alias("doc"), F.from_json(F.to_json(nested), KNOWLEDGE).alias("d")).select("doc", "d.*")
    return knowledge_chunks(d, ["doc"], zone_prefix="Part ", outcome_source="book", zone_source="map")


NAME_LIST = [("aten", "d"), ("ción", "c"), ("ation", "a"), ("eaux", "b"), ("src1", "e")]


@query("f14_type_and_tags", """SELECT doc_id, CASE lang WHEN 'en' THEN 'feature' WHEN 'fr' THEN 'pattern' ELSE 'card' END AS type,
  array_to_string(list_sort(list_filter([CASE WHEN contains(b, 'aten') THEN 'd' END, CASE WHEN contains(b, 'ción') THEN 'c' END, CASE WHEN contains(b, 'ation') THEN 'a' END, CASE WHEN contains(b, 'eaux') THEN 'b' END, CASE WHEN contains(b, 'src1') THEN 'e' END], lambda t: t IS NOT NULL)), ',') AS tags
  FROM (SELECT doc_id, lang, lower(lang || ':' || source || ' ' || text) AS b FROM documents)""")
def f14(spark, sf):
    d = docs(spark, sf, "lang", "source", "text").withColumn("id", F.concat_ws(":", "lang", "source"))
    t = C.type_and_tags(d, "id", "text", {"en": "feature", "fr": "pattern"}, NAME_LIST)
    return t.select("doc_id", "type", F.array_join("tags", ",").alias("tags"))


ALIASES = [("src1", "k1"), ("src12", "k2"), ("src3", "k3"), ("rc4", "k4"), ("src5", "k5"), ("src6", "k5")]
REGISTRY = {"k1": ("web", "quote"), "k2": ("copyrighted", "summary"), "k3": ("academic", "cite"), "k4": ("CC-BY", "quote"), "k5": ("own", "permission-pending")}
LICENSE_RANK = {"copyrighted": 5, "academic": 3, "CC-BY": 2, "web": 1, "own": 0}
C_LIC = """lic AS (SELECT doc_id, lang, n_chars, text, source, CASE WHEN source = 'src12' THEN 'k2,k1' WHEN starts_with(source, 'src1') THEN 'k1' WHEN source = 'src3' THEN 'k3' WHEN source = 'src4' THEN 'k4' WHEN source IN ('src5','src6') THEN 'k5' ELSE '' END AS keys FROM documents),
lc AS (SELECT *, CASE keys WHEN 'k2,k1' THEN 'copyrighted' WHEN 'k1' THEN 'web' WHEN 'k3' THEN 'academic' WHEN 'k4' THEN 'CC-BY' ELSE 'own' END AS license,
  CASE keys WHEN 'k2,k1' THEN 'summary' WHEN 'k1' THEN 'quote' WHEN 'k3' THEN 'cite' WHEN 'k4' THEN 'quote' WHEN 'k5' THEN 'permission-pending' ELSE 'authored-summary' END AS usage FROM lic)"""


def licensed(spark, sf, *cols: str) -> DataFrame:
    return C.resolve_license(docs(spark, sf, "source", *cols), F.col("source"), ALIASES, REGISTRY, LICENSE_RANK)


@query("f15_resolve_license", with_([C_LIC], "SELECT doc_id, keys AS source_keys, license, usage FROM lc"))
def f15(spark, sf):
    return licensed(spark, sf).select("doc_id", F.array_join("source_keys", ",").alias("source_keys"), "license", "usage")


C_NEAR = r"""nd AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY substr(regexp_replace(lower(text), '\s+', ' ', 'g'), 1, 80) ORDER BY doc_id) AS previous FROM documents)"""


@query("w12_near_dup", with_([C_NEAR], "SELECT doc_id, previous FROM nd WHERE previous IS NOT NULL"))
def w12(spark, sf):
    return C.near_dup(docs(spark, sf, "text"), "doc_id", "text")


@query("f22_lint_corpus", with_([C_LIC, C_NEAR], """SELECT doc_id, 'problem' AS level, 'unregistered source' AS issue FROM lc WHERE keys = '' UNION ALL SELECT doc_id, 'problem', 'pending source' FROM lc WHERE usage = 'permission-pending'
 UNION ALL SELECT doc_id, 'warning', 'very short' FROM lc WHERE length(text) < 40 UNION ALL SELECT doc_id, 'warning', 'long' FROM lc WHERE length(text) > 900
 UNION ALL SELECT doc_id, 'problem', 'duplicate id' FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, n_chars ORDER BY doc_id) AS rn FROM lc) WHERE rn > 1
 UNION ALL SELECT doc_id, 'warning', 'near duplicate' FROM nd WHERE previous IS NOT NULL"""))
def f22(spark, sf):
    d = licensed(spark, sf, "lang", "n_chars", "text").withColumn("cid", F.concat_ws("-", "lang", F.col("n_chars").cast("string")))
    return C.lint_corpus(d, "doc_id", "cid", "text", "source", F.size("source_keys"), F.col("usage"))


@query("f23_stem", r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/?#]+)(?:[?#].*)?$', 1), '(.)\.[^.]*$', '\1') AS stem FROM pages")
def f23(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.stem(F.col("url")).alias("stem"))


@query("f25_search_terms", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt')")
def f25(spark, sf):
    return C.search_terms(table(spark, sf, "part"), "BOLT", ["p_name", "p_brand"]).select("p_partkey", "p_name")


@query("f7_parse_glossary", """SELECT CAST(100 + p_partkey % 900 AS VARCHAR) AS code, arg_min(p_name, p_partkey) AS en, arg_min('脉' || p_size, p_partkey) AS zh, arg_min(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE lower(p_type) END, p_partkey) AS romanised FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1""")
def f7(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, F.lit("x")).otherwise((F.lit(100) + k % 900).cast("string"))
    line = F.concat(F.lit("  "), code, F.lit(" defined as  "), "p_name", F.lit("   脉"), F.col("p_size").cast("string"), F.lit("   "), F.when(k % 3 == 0, F.lit("9 x")).otherwise(F.lower("p_type")))
    return C.parse_glossary(p.select("p_partkey", line.alias("line")), "line", "p_partkey")


# ---- sections: every document line becomes a numbered or titled section -----------------------


def sectioned(spark, sf, titled: bool = False) -> DataFrame:
    """Documents with a heading before each line, built inside the row; a contents line with a
    dot leader and a repeated heading precede them."""
    ln = F.split("text", "\n")
    letter = lambda i: F.chr(F.lit(97) + i % 26)
    if titled:
        head = lambda i: F.concat(F.lit("Part "), letter(i), F.lit(" of "), F.col("lang"))
        front = F.lit("   Part of contents\n")
    else:
        sub = lambda i: F.when(i % 3 == 0, "1").when(i % 3 == 1, "2").otherwise("2.1")
        head = lambda i: F.concat(F.floor(i / 3 + 1).cast("string"), F.lit("."), sub(i), F.lit(" Part "), F.col("lang"), F.lit(" "), letter(i))
        front = F.lit("1.1 Part one . . . 3\n1.1 Part again\n")
    page = lambda i: F.when(i % 5 == 4, "\f").otherwise("")
    tab = lambda i: F.when(i % 4 == 1, "\t").otherwise("")
    body = F.array_join(F.transform(ln, lambda x, i: F.concat(page(i), tab(i), head(i), F.lit("\n"), x)), "\n")
    return docs(spark, sf, "lang", "text").select("doc_id", F.concat(front, body).alias("text"))


C_SECDOC = r"""l0 AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents),
l1 AS (SELECT doc_id, lang, i-1 AS i, l[i] AS line FROM l0, LATERAL (SELECT unnest(range(1, len(l)+1)) AS i)),
sd AS (SELECT doc_id, '1.1 Part one . . . 3' || chr(10) || '1.1 Part again' || chr(10) || string_agg(CASE WHEN i%5 = 4 THEN chr(12) ELSE '' END || CASE WHEN i%4 = 1 THEN chr(9) ELSE '' END || (i//3+1) || '.' || CASE i%3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '2.1' END || ' Part ' || lang || ' ' || chr(CAST(97+i%26 AS INT)) || chr(10) || line, chr(10) ORDER BY i) AS text FROM l1 GROUP BY 1),
td AS (SELECT doc_id, '   Part of contents' || chr(10) || string_agg(CASE WHEN i%5 = 4 THEN chr(12) ELSE '' END || CASE WHEN i%4 = 1 THEN chr(9) ELSE '' END || 'Part ' || chr(CAST(97+i%26 AS INT)) || ' of ' || lang || chr(10) || line, chr(10) ORDER BY i) AS text FROM l1 GROUP BY 1)"""


def heads_sql(src: str, num: str, good: str) -> str:
    return rf"""m0 AS (SELECT doc_id, text, string_split_regex(text, '[\n\f]') AS l FROM {src}),
m1 AS (SELECT doc_id, length(text) AS tl, i AS pos, l[i] AS line FROM m0, LATERAL (SELECT unnest(range(1, len(l)+1)) AS i)),
m2 AS (SELECT *, coalesce(sum(length(line)+1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM m1),
m3 AS (SELECT *, {num} AS num FROM m2 WHERE {good}),
m4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, num ORDER BY pos DESC) AS back FROM m3),
m5 AS (SELECT doc_id, num, line, tl, st, least(st+length(line)+1, tl) AS body_start, coalesce(lead(st) OVER (PARTITION BY doc_id ORDER BY st), tl) AS body_end FROM m4 WHERE back = 1)"""


NUM_RE = r"^[ \t]*(\d+(?:\.\d+){1,3})[ \t]+(\S.*\S)[ \t]*$"
C_HEADS = heads_sql(
    "sd", rf"regexp_extract(line, '{NUM_RE}', 1)",
    rf"regexp_matches(line, '{NUM_RE}') AND NOT regexp_matches(line, '\.[ \t]+\.') AND NOT regexp_matches(line, '\s\d{{1,3}}$') AND length(regexp_extract(line, '{NUM_RE}', 2)) BETWEEN 3 AND 80 AND regexp_matches(regexp_extract(line, '{NUM_RE}', 2), '^\p{{L}}')",
)
C_SEC = rf"""sec AS (SELECT doc_id, num, trim(regexp_extract(line, '{NUM_RE}', 2)) AS title, CAST(len(string_split(num, '.')) AS INT) AS level, array_to_string(string_split(num, '.')[1:len(string_split(num, '.'))-1], '.') AS parent,
 string_split(num, '.')[1] AS chapter, CAST(body_start AS INT) AS body_start, CAST(body_end AS INT) AS body_end, CAST(body_end-body_start AS INT) AS n_chars FROM m5)"""
P_SEC = [C_SECDOC, C_HEADS, C_SEC]


def sections(spark, sf) -> DataFrame:
    return C.parse_numbered(sectioned(spark, sf), "doc_id", "text")


@query("f5_parse_numbered", with_(P_SEC, "SELECT * FROM sec"))
def f5(spark, sf):
    return sections(spark, sf)


@query("w4_spans", with_(P_SEC, "SELECT doc_id, num, body_start, body_end, n_chars FROM sec"))
def w4(spark, sf):
    return sections(spark, sf).select("doc_id", "num", "body_start", "body_end", "n_chars")


@query("w3_last_per_key", with_([C_SECDOC, C_HEADS], "SELECT doc_id, num, pos - 1 AS pos FROM m4 WHERE back = 1"))
def w3(spark, sf):
    line = F.col("line")
    d = sectioned(spark, sf).select("doc_id", F.posexplode(C.split_lines(F.col("text"))).alias("pos", "line"))
    d = d.withColumn("line", C.bare(line))
    title = F.trim(F.regexp_extract(line, C.NUMBERED, 2))
    good = line.rlike(C.NUMBERED) & ~line.rlike(C.LEADER) & ~line.rlike(C.PAGE_END) & F.length(title).between(3, 80) & title.rlike(r"^\p{L}")
    h = d.filter(good).select("doc_id", F.regexp_extract(line, C.NUMBERED, 1).alias("num"), "pos")
    return C.last_per_key(h, ["doc_id", "num"], "pos")


TITLE_SQL = C.TITLE.replace("'", "''")


@query("f6_parse_titled", with_([C_SECDOC, heads_sql("td", "trim(line, chr(9) || ' ')", rf"length(line) - length(ltrim(line, chr(9) || ' ')) <= 2 AND regexp_matches(trim(line, chr(9) || ' '), '{TITLE_SQL}') AND len(regexp_split_to_array(trim(line, chr(9) || ' '), '\s+')) <= 8")], """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) AS VARCHAR) AS num, num AS title, 1 AS level, CAST(NULL AS VARCHAR) AS parent, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) AS VARCHAR) AS chapter, CAST(body_start AS INT) AS body_start, CAST(body_end AS INT) AS body_end, CAST(body_end-body_start AS INT) AS n_chars FROM m5"""))
def f6(spark, sf):
    return C.parse_titled(sectioned(spark, sf, titled=True), "doc_id", "text")


@query("src7_slice_sections", with_(P_SEC, "SELECT doc_id, num, md5(trim(substr(sd.text, body_start+1, n_chars))) AS h, length(trim(substr(sd.text, body_start+1, n_chars))) AS n FROM sec JOIN sd USING (doc_id)"))
def src7(spark, sf):
    s = C.slice_sections(sectioned(spark, sf), sections(spark, sf), "doc_id", "text")
    return s.select("doc_id", "num", F.md5("body").alias("h"), F.length("body").alias("n"))


@query("pr16_section_scope", with_(P_SEC, "SELECT doc_id, num, n_chars FROM sec WHERE n_chars >= 200 AND chapter IN ('1','2','4')"))
def pr16(spark, sf):
    return C.section_scope(sections(spark, sf), ["1", "2", "4"]).select("doc_id", "num", "n_chars")


@query("g2_hierarchy", with_(P_SEC, """, h AS (SELECT doc_id, num, CASE WHEN parent <> '' THEN parent ELSE chapter END AS up FROM sec)
 SELECT doc_id, 'section:' || num AS src, 'section:' || up AS dst, 'section_of' AS kind FROM h UNION ALL SELECT DISTINCT doc_id, 'section:' || up, '', CASE WHEN contains(up, '.') THEN 'stub' ELSE 'chapter' END FROM h WHERE (doc_id, up) NOT IN (SELECT (doc_id, num) FROM sec)"""))
def g2(spark, sf):
    from sigweave.operators.graph import hierarchy

    edges, stubs = hierarchy(sections(spark, sf), "doc_id")
    return edges.select("doc_id", "src", "dst", F.lit("section_of").alias("kind")).unionByName(stubs.select("doc_id", F.col("node").alias("src"), F.lit("").alias("dst"), "kind"))


# ---- substring joins and citations -------------------------------------------------------------


@query("j9_contains_join", "SELECT doc_id, CASE WHEN contains(t, 'ation') THEN 'growth' WHEN contains(t, 'eaux') THEN 'friction' WHEN contains(t, 'schen') THEN 'dormant' WHEN contains(t, 'ción') THEN 'loyalty' WHEN contains(t, 'the') THEN 'churn' END AS first_hit, CAST(contains(t,'ation') AS INT)+CAST(contains(t,'eaux') AS INT)+CAST(contains(t,'schen') AS INT)+CAST(contains(t,'ción') AS INT)+CAST(contains(t,'the') AS INT) AS n_hits FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def j9(spark, sf):
    t = F.lower("text")
    return docs(spark, sf, "text").select("doc_id", M.contains_first(t, LEXICON).alias("first_hit"), F.size(M.contains_any(t, LEXICON)).alias("n_hits"))


@query("j9_verbatim_items", r"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM benchmark)
 SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, b.t)""")
def j9v(spark, sf):
    return M.contains_join(docs(spark, sf, "text"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")


@query("j12_validate_citations", r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1 END AS section, '  ' || translate(substr(text, CAST(1 + (doc_id*7919) % greatest(length(text) - 300, 1) AS BIGINT), 300), 'aeiou', 'AEIOU') || ' ' AS snippet FROM documents)
 SELECT t.doc_id, substr(trim(snippet), 1, 200) AS snippet FROM t JOIN documents d ON d.doc_id = t.section WHERE contains(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(snippet), '\s+', ' ', 'g')))""")
def j12(spark, sf):
    d = docs(spark, sf, "text")
    sec = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1)
    at = (F.lit(1) + (F.col("doc_id") * 7919) % F.greatest(F.length("text") - 300, F.lit(1))).cast("int")  # anywhere in the text
    trip = d.select("doc_id", sec.alias("section"), F.concat(F.lit("  "), F.translate(F.substring("text", at, F.lit(300)), "aeiou", "AEIOU"), F.lit(" ")).alias("snippet"))
    return M.validate_citations(trip, d.select(F.col("doc_id").alias("section"), "text"), "section", "snippet", "text").select("doc_id", "snippet")


OUR_AXES = [("ation", "rise"), ("eaux", "strain"), ("schen", "fall"), ("ción", "rise"), ("ente", "strain")]
GOLD_AXES = [("tion", "rise"), ("que", "strain"), ("der", "fall"), ("los", "rise"), ("with", "calm")]


def axes(spark, sf) -> DataFrame:
    t = F.lower("text")
    ax = lambda words: F.array_distinct(F.transform(M.contains_any(t, words), lambda e: e["key"]))
    return docs(spark, sf, "text").select("doc_id", ax(OUR_AXES).alias("ours"), ax(GOLD_AXES).alias("gold"))


def axes_sql(words) -> str:
    return "list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(t, '{w}') THEN '{a}' END" for w, a in words) + "], lambda a: a IS NOT NULL))"


C_AXES = f"axs AS (SELECT doc_id, {axes_sql(OUR_AXES)} AS ours, {axes_sql(GOLD_AXES)} AS gold FROM (SELECT doc_id, lower(text) AS t FROM documents))"


@query("j17_axis_match", with_([C_AXES], "SELECT doc_id, len(ours) AS n_ours, len(gold) AS n_gold, list_has_any(ours, gold) AS matched FROM axs"))
def j17(spark, sf):
    return axes(spark, sf).select("doc_id", F.size("ours").alias("n_ours"), F.size("gold").alias("n_gold"), F.arrays_overlap("ours", "gold").alias("matched"))


@query("a23_axis_recall", with_([C_AXES], f""", x AS (SELECT CAST(list_has_any(ours, gold) AS INT) AS hit, unnest(list_append(gold, 'ALL')) AS axis FROM axs WHERE len(gold) > 0) SELECT axis, count(*) AS n, sum(hit) AS n_hit, {r('avg(hit)')} AS rate FROM x GROUP BY 1"""))
def a23(spark, sf):
    return C.axis_recall(axes(spark, sf), "ours", "gold")


T7_W = [("ation", "growth", 1.0), ("tion", "growth", 0.5), ("eaux", "friction", 1.2), ("que", "friction", 0.3), ("schen", "dormant", 1.5), ("ción", "loyalty", 1.1), ("the", "churn", 0.9)]


@query("t7_argmax", """WITH s AS (SELECT doc_id, CASE WHEN contains(t,'ation') THEN 1.0 ELSE 0 END + CASE WHEN contains(t,'tion') THEN 0.5 ELSE 0 END AS growth, CASE WHEN contains(t,'eaux') THEN 1.2 ELSE 0 END + CASE WHEN contains(t,'que') THEN 0.3 ELSE 0 END AS friction,
 CASE WHEN contains(t,'schen') THEN 1.5 ELSE 0 END AS dormant, CASE WHEN contains(t,'ción') THEN 1.1 ELSE 0 END AS loyalty, CASE WHEN contains(t,'the') THEN 0.9 ELSE 0 END AS churn FROM (SELECT doc_id, lower(text) AS t FROM documents)),
 u AS (UNPIVOT s ON growth, friction, dormant, loyalty, churn INTO NAME outcome VALUE score)
 SELECT doc_id, CASE WHEN max(score) > 0 THEN arg_max(outcome, {'s': score, 'o': outcome}) ELSE 'balanced' END AS outcome FROM u GROUP BY 1""")
def t7(spark, sf):
    from sigweave.operators.report import literal_argmax

    return docs(spark, sf, "text").select("doc_id", literal_argmax(F.lower("text"), T7_W, "balanced").alias("outcome"))


@query("a30_corpus_stats", with_([C_LIC], "SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM lc GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM lc GROUP BY 2 UNION ALL SELECT 'license', license, count(*) FROM lc GROUP BY 2 UNION ALL SELECT 'usage', usage, count(*) FROM lc GROUP BY 2"))
def a30(spark, sf):
    return C.corpus_stats(licensed(spark, sf, "lang"), ["lang", "source", "license", "usage"])


# ---- retrieval -----------------------------------------------------------------------------------

_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


def terms_sql(name: str, src: str, key: str) -> str:
    return rf"""{name}_w AS (SELECT {key}, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({_STOP_SQL})) AS w FROM {src}),
{name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(w) AS term FROM {name}_w UNION ALL SELECT {key}, w[i] || ' ' || w[i+1] FROM {name}_w, LATERAL (SELECT unnest(range(1, len(w))) AS i)) GROUP BY 1, 2)"""


C_TFIDF = f"""{terms_sql('dt', 'documents', 'doc_id')}, {terms_sql('qt', 'benchmark', 'item_id')},
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents))/(1.0::DOUBLE + count(*))) + 1.0 AS idf FROM dt GROUP BY 1),
dw AS (SELECT doc_id, term, tf*idf AS w FROM dt JOIN idf USING (term)), qw AS (SELECT item_id, term, tf*idf AS w FROM qt JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w*w)) AS n FROM dw GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(w*w)) AS n FROM qw GROUP BY 1),
lx AS (SELECT q.item_id, d.doc_id, {r('sum(d.w*q.w)/(any_value(dn.n)*any_value(qn.n))', 9)} AS score FROM qw q JOIN dw d USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY 1, 2),
lex AS (SELECT item_id, doc_id, score, CAST(rn-1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM lx) WHERE rn <= 15)"""


def lexical(spark, sf) -> DataFrame:
    return R.tfidf_topk(docs(spark, sf, "text"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text", STOP)


@query("r1_tfidf", with_([C_TFIDF], f"SELECT item_id, doc_id, rank, {r('score')} AS score FROM lex"))
def r1(spark, sf):
    return lexical(spark, sf).select("item_id", "doc_id", "rank", S.rnd(F.col("score"), 6).alias("score"))


def centroids(spark, sf) -> DataFrame:
    """One query vector per class: the mean embedding (a bounded batch of queries)."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("label", "i").agg(S.rnd(F.avg(F.col("v").cast("double")), 9).alias("v"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("qv"))


C_CENT = f"""cm AS (SELECT label, i, {r('avg(embedding[i]::DOUBLE)', 9)} AS v FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2),
cent AS (SELECT label, list(v ORDER BY i) AS qv FROM cm GROUP BY 1),
nrm AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
cs AS (SELECT c.label AS query_id, n.vec_id AS vector_id, n.label, {r('list_dot_product(c.qv, n.v)/(sqrt(list_dot_product(c.qv, c.qv))*sqrt(list_dot_product(n.v, n.v)))', 9)} AS score FROM cent c CROSS JOIN nrm n),
vec AS (SELECT query_id, vector_id, label, score, CAST(rn-1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rn FROM cs) WHERE rn <= 15)"""


def semantic(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return R.cosine_topk(e, "vec_id", "embedding", centroids(spark, sf), "label", "qv", 15)


@query("r2_cosine_topk", with_([C_CENT], f"SELECT query_id, vector_id, rank, {r('score')} AS score FROM vec"))
def r2(spark, sf):
    return semantic(spark, sf).select("query_id", "vector_id", "rank", S.rnd(F.col("score"), 6).alias("score"))


@query("r3_rrf", with_([C_TFIDF, C_CENT], f""", vl AS (SELECT b.item_id, v.vector_id AS doc_id, v.rank FROM benchmark b JOIN vec v ON v.query_id = b.item_id % 10),
 f AS (SELECT item_id, doc_id, {r('sum(1.0::DOUBLE/(60.0::DOUBLE+rank))', 9)} AS score FROM (SELECT item_id, doc_id, rank FROM lex UNION ALL SELECT item_id, doc_id, rank FROM vl) GROUP BY 1, 2)
 SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 5"""))
def r3(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 10).alias("query_id"))
    v = semantic(spark, sf).join(b, "query_id").select("item_id", F.col("vector_id").alias("doc_id"), "rank")
    return R.rrf([lexical(spark, sf), v], "item_id", "doc_id")


@query("a27_hit_at_k", with_([C_CENT], f"SELECT count(*) AS n, sum(h) AS n_hit, {r('avg(h)')} AS hit_rate FROM (SELECT query_id, max(CAST(label = query_id AS INT)) AS h FROM vec WHERE rank < 4 GROUP BY 1)"))
def a27(spark, sf):
    lab = table(spark, sf, "embeddings").select(F.col("vec_id").alias("vector_id"), "label")
    s = semantic(spark, sf).join(lab, "vector_id").withColumn("ok", F.col("label") == F.col("query_id"))
    return R.hit_at_k(s, "query_id", "ok", 4)


@query("w6_pool_rank", "SELECT source, doc_id, n_chars, CAST(rn-1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 15")
def w6(spark, sf):
    return R.pool_rank(docs(spark, sf, "source", "n_chars"), ["source"], "n_chars", "doc_id", 15)
