"""Label-engineering and evaluation queries over `documents` and `labels`.

Gold labels come from `labels` (sparse), weak labels from rules on the document's
size, source and language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.dims import Dim
from sigweave.functions import scores as S
from sigweave.operators import evaluate as E
from sigweave.operators import labels as L
from sigweave.operators import sampling as P
from sigweave.plans.base import query, r, with_
from sigweave.session import cut, scratch, table

GRADES = ["low", "mid", "high"]
DOMAIN = Dim(
    "dom",
    [("feature", "string"), ("value", "string"), ("ord", "int")],
    [("grade", g, i) for i, g in enumerate(GRADES)]
    + [("quality", "poor", 0), ("quality", "good", 1), ("toxic", "clean", 0), ("toxic", "toxic", 1)],
)
CLASSES = {"grade": GRADES, "quality": ["poor", "good"], "toxic": ["clean", "toxic"]}
GRID = [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8]


def weak(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars")
    return docs.select(
        "doc_id",
        F.when(n >= 800, "good").otherwise("poor").alias("quality"),
        F.when(F.col("source").isin("src3", "src7", "src13"), "toxic").otherwise("clean").alias("toxic"),
        F.when(n < 500, "low").when(n < 1500, "mid").when(n < 9000, "high").alias("grade"),
    )


def gold(labels: DataFrame) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    return labels.select(
        "doc_id",
        F.when(q == 1, "good").otherwise("poor").alias("quality_manual"),
        F.when(t == 1, "toxic").otherwise("clean").alias("toxic_manual"),
        F.when(q == 0, "low").when(t == 1, "mid").otherwise("high").alias("grade_manual"),
    )


def third(lang: Column) -> Column:
    return F.when(lang == "en", "good").when(lang == "fr", "poor")


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document: weak labels, sparse gold, third-party quality. `text` is never read."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    m = L.build_manifest(d, weak(d), gold(table(spark, sf, "labels")), "doc_id", ["quality_manual", "toxic_manual", "grade_manual"])
    return m.withColumn("quality_third", third(F.col("lang")))


def store(m: DataFrame) -> DataFrame:
    return L.label_store(
        [
            (m, {"grade": "grade", "quality": "quality", "toxic": "toxic"}, "auto"),
            (m, {"grade": "grade_manual", "quality": "quality_manual", "toxic": "toxic_manual"}, "expert"),
            (m, {"quality": "quality_third"}, "third"),
        ],
        "doc_id",
        ["lang"],
    )


def pairs(spark, sf) -> DataFrame:
    """Prediction/gold pairs unpivoted straight from the manifest row: no join of the store with itself."""
    m = manifest(spark, sf).filter("has_gold")
    slots = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("pred"), F.col(f"{f}_manual").alias("gold")) for f in ("grade", "quality", "toxic")])
    return m.select(F.col("doc_id").alias("entity"), "lang", "source", F.explode(slots).alias("s")).select("entity", "lang", "source", "s.*").filter("gold is not null and pred is not null")


C_MAN = """man AS (SELECT d.doc_id, d.lang, d.source, d.n_chars,
  CASE WHEN n_chars >= 800 THEN 'good' ELSE 'poor' END AS quality,
  CASE WHEN source IN ('src3','src7','src13') THEN 'toxic' ELSE 'clean' END AS toxic,
  CASE WHEN n_chars < 500 THEN 'low' WHEN n_chars < 1500 THEN 'mid' WHEN n_chars < 9000 THEN 'high' END AS grade,
  CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'poor' END AS quality_manual,
  CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'clean' END AS toxic_manual,
  CASE WHEN l.quality = 0 THEN 'low' WHEN l.toxic = 1 THEN 'mid' WHEN l.doc_id IS NOT NULL THEN 'high' END AS grade_manual,
  l.doc_id IS NOT NULL AS has_gold, CASE lang WHEN 'en' THEN 'good' WHEN 'fr' THEN 'poor' END AS quality_third
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
C_STORE = """store AS (SELECT * FROM (
  SELECT doc_id AS entity, lang, 'grade' AS feature, grade AS value, 'auto' AS source FROM man UNION ALL SELECT doc_id, lang, 'quality', quality, 'auto' FROM man
  UNION ALL SELECT doc_id, lang, 'toxic', toxic, 'auto' FROM man UNION ALL SELECT doc_id, lang, 'grade', grade_manual, 'expert' FROM man
  UNION ALL SELECT doc_id, lang, 'quality', quality_manual, 'expert' FROM man UNION ALL SELECT doc_id, lang, 'toxic', toxic_manual, 'expert' FROM man
  UNION ALL SELECT doc_id, lang, 'quality', quality_third, 'third' FROM man) WHERE value IS NOT NULL)"""
C_PAIRS = """pairs AS (SELECT a.entity, a.lang, d.source, a.feature, a.value AS pred, e.value AS gold FROM store a JOIN store e USING (entity, feature)
  JOIN documents d ON d.doc_id = a.entity WHERE a.source = 'auto' AND e.source = 'expert')"""
P_STORE = [C_MAN, C_STORE]
P_PAIRS = [C_MAN, C_STORE, C_PAIRS]


@query("pr1_norm_cat", "SELECT c_custkey, lower(trim(c_mktsegment || ' ')) AS segment FROM customer")
def pr1(spark, sf):
    from sigweave.functions.text import norm_cat

    return table(spark, sf, "customer").select("c_custkey", norm_cat(F.concat("c_mktsegment", F.lit(" "))).alias("segment"))


@query("pr2_guard", with_([*P_STORE, DOMAIN.cte()], "SELECT s.entity, s.feature, s.source, CASE WHEN d.ord IS NOT NULL AND s.value <> 'mid' THEN s.value END AS value, CASE WHEN s.value <> 'mid' THEN d.ord END AS ord FROM store s LEFT JOIN dom d USING (feature, value)"))
def pr2(spark, sf):
    d = DOMAIN.small(spark).filter("value <> 'mid'")
    return L.guard(store(manifest(spark, sf)), d).select("entity", "feature", "source", "value", "ord")


@query("j1_build_manifest", with_([C_MAN], "SELECT doc_id, lang, quality, toxic, grade, quality_manual, toxic_manual, grade_manual, has_gold FROM man"))
def j1(spark, sf):
    return manifest(spark, sf).select("doc_id", "lang", "quality", "toxic", "grade", "quality_manual", "toxic_manual", "grade_manual", "has_gold")


@query("pr3_resolve_target", with_([C_MAN], """SELECT doc_id, CAST(CASE coalesce(grade_manual, grade) WHEN 'mid' THEN 1 WHEN 'high' THEN 2 ELSE 0 END AS INT) AS target,
  CASE WHEN grade_manual IS NOT NULL THEN 2.0 WHEN grade IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM man"""))
def pr3(spark, sf):
    return L.resolve_target(manifest(spark, sf), "grade", "grade_manual", GRADES).select("doc_id", "target", "weight")


@query("pr4_severity", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {r("greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_quantity*coalesce(nullif(l_discount, 0.0), 0.0)/10.0::DOUBLE))")} AS area_sev,
  {r("coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (l_quantity*4 - 10.0::DOUBLE)/200.0::DOUBLE)), 0.0)")} AS cover_sev FROM lineitem""")
def pr4(spark, sf):
    li = table(spark, sf, "lineitem")
    disc = F.nullif(F.col("l_discount"), F.lit(0.0))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        S.rnd(L.area_severity(F.col("l_quantity"), disc), 6).alias("area_sev"),
        S.rnd(L.coverage_severity(F.col("l_quantity") * 4), 6).alias("cover_sev"),
    )


@query("a7_summary", f"""WITH s AS (SELECT l_returnflag, {r("least(1.0::DOUBLE, l_quantity*l_discount/10.0::DOUBLE)", 4)} AS sev FROM lineitem)
  SELECT l_returnflag, count(*) AS n, {r("avg(sev)")} AS mean_sev, {r("quantile_cont(sev, 0.5)", 5)} AS p50, {r("quantile_cont(sev, 0.9)", 5)} AS p90,
  {r("avg(CASE WHEN sev > 0.1 THEN 1.0 ELSE 0.0 END)*100", 4)} AS prevalence FROM s GROUP BY 1""")
def a7(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    s = S.rnd(L.area_severity(F.col("l_quantity"), F.col("l_discount")), 4)
    return severity_summary(li.withColumn("sev", s), "l_returnflag", "sev", 0.1)


def severity_summary(df: DataFrame, by: str, sev: str, cut_at: float) -> DataFrame:
    """Mean, p50, p90 and prevalence of a four-decimal severity in [0, 1] (at most 10,001 counts per percentile buffer)."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"),
        S.rnd(F.avg(sev), 6).alias("mean_sev"),
        S.rnd(F.percentile(sev, 0.5), 5).alias("p50"),
        S.rnd(F.percentile(sev, 0.9), 5).alias("p90"),
        S.rnd(F.avg((F.col(sev) > cut_at).cast("double")) * 100, 4).alias("prevalence"),
    )


@query("u2_label_store", with_(P_STORE, "SELECT entity, feature, value, source FROM store"))
def u2(spark, sf):
    return store(manifest(spark, sf)).select("entity", "feature", "value", "source")


@query("pr6_to_presence", with_(P_STORE, "SELECT entity, feature, source, CASE WHEN CASE value WHEN 'low' THEN 'none' WHEN 'poor' THEN 'no' WHEN 'clean' THEN 'absent' ELSE value END IN ('none','no','absent') THEN 'absent' ELSE 'present' END AS presence FROM store"))
def pr6(spark, sf):
    v = F.col("value")
    word = F.when(v == "low", "none").when(v == "poor", "no").when(v == "clean", "absent").otherwise(v)
    return store(manifest(spark, sf)).select("entity", "feature", "source", L.to_presence(word).alias("presence"))


@query("pr7_scope", with_(P_STORE, """, s AS (SELECT * FROM store WHERE source = 'expert' AND lang = 'en' AND feature IN ('quality','grade'))
  SELECT entity, feature, value FROM s WHERE entity IN (SELECT DISTINCT entity FROM s ORDER BY entity LIMIT 50)"""))
def pr7(spark, sf):
    s = store(manifest(spark, sf)).withColumnRenamed("lang", "split")
    return L.scope(s, "expert", "en", ["quality", "grade"], 50).select("entity", "feature", "value")


@query("j2_existence", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey) AS has_pair, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS unseen FROM customer""")
def j2(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    # Per-customer flags first: one map-side combined aggregate serves both tests.
    f = o.groupBy("c_custkey").agg(F.lit(True).alias("p"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    return c.join(f, "c_custkey", "left").select("c_custkey", F.coalesce("p", F.lit(False)).alias("has_pair"), (~F.coalesce("u", F.lit(False))).alias("unseen"))


@query("j3_agreement", with_(P_STORE, """SELECT a.entity, a.feature, a.value AS va, b.value AS vb, a.value = b.value AS agree FROM store a JOIN store b USING (entity, feature) WHERE a.source = 'auto' AND b.source = 'expert'"""))
def j3(spark, sf):
    return L.agreement(store(manifest(spark, sf)), "auto", "expert")


@query("j4_crosswalk", """WITH m AS (SELECT page_id AS doc_id, regexp_extract(url, '([^/?#]+)(?:[?#].*)?$', 1) AS p FROM pages)
  SELECT d.doc_id, coalesce(m.p, 'data/' || d.doc_id || '.jpg') AS path FROM documents d LEFT JOIN m USING (doc_id)""")
def j4(spark, sf):
    from sigweave.functions.text import basename

    m = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), basename(F.col("url")).alias("p"))
    d = table(spark, sf, "documents").select("doc_id")
    return L.crosswalk(d, m, "doc_id", "p", F.concat(F.lit("data/"), F.col("doc_id").cast("string"), F.lit(".jpg")))


@query("j10_score_pairs", with_([*P_PAIRS, DOMAIN.cte()], "SELECT entity, feature, pred, gold FROM pairs JOIN dom d ON d.feature = pairs.feature AND d.value = pairs.gold".replace("SELECT entity, feature,", "SELECT entity, pairs.feature,")))
def j10(spark, sf):
    s = store(manifest(spark, sf))
    return E.score_pairs(s.filter("source = 'auto'"), s.filter("source = 'expert'"), DOMAIN.small(spark)).select("entity", "feature", "pred", "gold")


@query("j18_compare_mentioned", with_(P_STORE, """SELECT e.feature, count(*) AS n_mentioned, count(a.value) AS n_answered, count(*) FILTER (a.value = e.value) AS n_ok
  FROM store e LEFT JOIN store a ON a.entity = e.entity AND a.feature = e.feature AND a.source = 'third' WHERE e.source = 'expert' GROUP BY 1"""))
def j18(spark, sf):
    s = store(manifest(spark, sf)).filter("source in ('expert', 'third')")
    side = lambda k: F.max(F.when(F.col("source") == k, F.col("value")))
    p = s.groupBy("entity", "feature").agg(side("expert").alias("g"), side("third").alias("a")).filter("g is not null")
    return p.groupBy("feature").agg(F.count("*").alias("n_mentioned"), F.count("a").alias("n_answered"), F.count(F.when(F.col("a") == F.col("g"), 1)).alias("n_ok"))


@query("a1_coverage", with_(P_STORE, "SELECT feature, count(*) FILTER (source = 'auto') AS auto, count(*) FILTER (source = 'expert') AS expert, count(*) FILTER (source = 'third') AS third FROM store GROUP BY 1"))
def a1(spark, sf):
    return L.coverage(store(manifest(spark, sf)), "feature", "source", ["auto", "expert", "third"])


@query("a2_profile", """SELECT 'c_mktsegment' AS "column", count(c_mktsegment) AS n_non_null, count(DISTINCT c_mktsegment) AS n_classes FROM customer
  UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(DISTINCT c_nationkey) FROM customer""")
def a2(spark, sf):
    return L.profile(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


@query("a2_distribution", """SELECT 'c_mktsegment' AS "column", c_mktsegment AS class, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 2""")
def a2_distribution(spark, sf):
    return L.class_counts(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


@query("a3_overlap", with_(P_STORE, "SELECT count(*) AS n_common FROM (SELECT entity FROM store WHERE source = 'expert' INTERSECT SELECT entity FROM store WHERE source = 'third')"))
def a3(spark, sf):
    s = store(manifest(spark, sf))
    return s.filter("source = 'expert'").select("entity").intersect(s.filter("source = 'third'").select("entity")).agg(F.count("*").alias("n_common"))


@query("a4_multi_hot", "SELECT l_orderkey, max(CASE WHEN l_linenumber=1 THEN 1 ELSE 0 END) AS red, max(CASE WHEN l_linenumber=2 THEN 1 ELSE 0 END) AS dots, max(CASE WHEN l_linenumber=6 THEN 1 ELSE 0 END) AS thin FROM lineitem GROUP BY 1")
def a4(spark, sf):
    return L.multi_hot(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", {1: "red", 2: "dots", 6: "thin"})


@query("a10_confusion", with_(P_PAIRS, f"SELECT feature, gold, pred, count(*) AS n, {r('count(*)/sum(count(*)) OVER (PARTITION BY feature, gold)')} AS share FROM pairs GROUP BY 1, 2, 3"))
def a10(spark, sf):
    return E.confusion(pairs(spark, sf))


@query("a11_multiclass", with_(P_PAIRS, f""", cls AS (SELECT feature, gold AS c FROM pairs UNION SELECT feature, pred FROM pairs),
  per AS (SELECT c.feature, c.c, count(*) FILTER (gold = c AND pred = c) AS tp, count(*) FILTER (gold = c) AS g, count(*) FILTER (pred = c) AS p FROM cls c JOIN pairs x USING (feature) GROUP BY 1, 2),
  m AS (SELECT *, CASE WHEN p = 0 THEN 0.0 ELSE tp/p END AS pr, CASE WHEN g = 0 THEN 0.0 ELSE tp/g END AS rc FROM per)
  SELECT feature, sum(g) AS n, {r('sum(tp)/sum(g)')} AS accuracy, {r('avg(pr)')} AS macro_p, {r('avg(rc)')} AS macro_r, {r('avg(CASE WHEN pr+rc = 0 THEN 0.0 ELSE 2*pr*rc/(pr+rc) END)')} AS macro_f1 FROM m GROUP BY 1"""))
def a11(spark, sf):
    return E.multiclass(pairs(spark, sf))


@query("a11_per_class", with_(P_PAIRS, f""", cls AS (SELECT feature, gold AS c FROM pairs UNION SELECT feature, pred FROM pairs),
  per AS (SELECT c.feature, c.c, count(*) FILTER (gold = c AND pred = c) AS tp, count(*) FILTER (gold = c) AS g, count(*) FILTER (pred = c) AS p FROM cls c JOIN pairs x USING (feature) GROUP BY 1, 2),
  m AS (SELECT *, CASE WHEN p = 0 THEN 0.0 ELSE tp/p END AS pr, CASE WHEN g = 0 THEN 0.0 ELSE tp/g END AS rc FROM per)
  SELECT feature, c AS cls, CAST(g AS BIGINT) AS n_gold, {r('CASE WHEN pr+rc = 0 THEN 0.0 ELSE 2*pr*rc/(pr+rc) END')} AS f1 FROM m"""))
def a11_per_class(spark, sf):
    return E.per_class(pairs(spark, sf)).select("feature", "cls", "n_gold", S.rnd(F.col("f1"), 6).alias("f1"))


def presence_pairs(spark, sf) -> DataFrame:
    pos = lambda c: F.col(c).isin("good", "toxic", "mid", "high")
    return pairs(spark, sf).select("entity", "lang", "source", "feature", pos("pred").alias("pred"), pos("gold").alias("gold"))


def prf_sql(tp="tp", fp="fp", fn="fn") -> str:
    p = f"coalesce({tp}/nullif({tp}+{fp},0), 0.0)"
    q = f"coalesce({tp}/nullif({tp}+{fn},0), 0.0)"
    return f"{r(p)} AS precision, {r(q)} AS recall, {r(f'coalesce(2*{p}*{q}/nullif({p}+{q},0), 0.0)')} AS f1"


@query("a12_binary_prf", with_(P_PAIRS, f""", b AS (SELECT feature, pred IN ('good','toxic','mid','high') AS p, gold IN ('good','toxic','mid','high') AS g FROM pairs),
  c AS (SELECT feature, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn FROM b GROUP BY 1)
  SELECT *, {prf_sql()}, {r('(tp+fn)/(tp+fp+fn+tn)')} AS pos_rate FROM c"""))
def a12(spark, sf):
    return E.binary_prf(presence_pairs(spark, sf))


def scored(spark, sf) -> DataFrame:
    """(feature, doc_id, score in [0, 1], g): document size as the score of both binary labels."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    g = table(spark, sf, "labels")
    j = g.join(d, "doc_id").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0)).alias("score"), "quality", "toxic")
    slots = F.array(F.struct(F.lit("quality").alias("feature"), F.col("quality").alias("g")), F.struct(F.lit("toxic").alias("feature"), F.col("toxic").alias("g")))
    return j.select("doc_id", "score", F.explode(slots).alias("s")).select("doc_id", "score", "s.*")


C_SCORED = """scored AS (SELECT doc_id, least(1.0::DOUBLE, n_chars/4000.0::DOUBLE) AS score, f AS feature, CASE f WHEN 'quality' THEN quality ELSE toxic END AS g
  FROM documents JOIN labels USING (doc_id) CROSS JOIN (VALUES ('quality'), ('toxic')) x(f))"""


@query("a13_average_precision", with_([C_SCORED], f""", k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, doc_id) AS i, sum(g) OVER (PARTITION BY feature ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp FROM scored)
  , p AS (SELECT feature, count(*) AS n, sum(g) AS n_pos, {r('avg(CASE WHEN g = 1 THEN tp/i END)')} AS ap FROM k GROUP BY 1)
  SELECT *, n_pos >= 20 AS reliable FROM p UNION ALL SELECT 'MACRO', sum(n), sum(n_pos), {r('avg(ap)')}, true FROM p WHERE n_pos >= 20"""))
def a13(spark, sf):
    return E.macro_map(cut(E.average_precision(scored(spark, sf), "doc_id")))


C_GRID = "grid(t) AS (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in GRID) + ")"
C_SWEEP = f"""sw AS (SELECT feature, t AS threshold, count(*) FILTER (score > t AND g = 1) AS tp, count(*) FILTER (score > t AND g = 0) AS fp, count(*) FILTER (score <= t AND g = 1) AS fn FROM scored CROSS JOIN grid GROUP BY 1, 2),
  m AS (SELECT *, {prf_sql()} FROM sw)"""


@query("a14_best_f1", with_([C_SCORED, C_GRID, C_SWEEP], """SELECT feature, CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END AS threshold, f1, CASE WHEN f1 > 0 THEN precision ELSE 0 END AS precision, CASE WHEN f1 > 0 THEN recall ELSE 0 END AS recall
  FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY f1 DESC, threshold) AS rn FROM m) WHERE rn = 1"""))
def a14(spark, sf):
    return E.best_f1(scored(spark, sf), GRID)


@query("a15_calibrate_cut", with_([C_SCORED, C_GRID, C_SWEEP], f"""SELECT feature, 'threshold' AS kind, threshold AS at, tp AS n, f1 AS figure FROM m
  UNION ALL SELECT feature, 'grade', g::DOUBLE, count(*), {r('avg(score)')} FROM scored GROUP BY feature, g
  UNION ALL SELECT feature, 'suggested', threshold, tp, f1 FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY f1 DESC, threshold) AS rn FROM m) WHERE rn = 1"""))
def a15(spark, sf):
    s = scored(spark, sf)
    m = E.with_prf(E.sweep_counts(s, GRID)).select("feature", F.lit("threshold").alias("kind"), F.col("threshold").alias("at"), F.col("tp").alias("n"), F.col("f1").alias("figure"))
    g = E.grade_means(s.withColumnRenamed("g", "gold")).select("feature", F.lit("grade").alias("kind"), F.col("gold").cast("double").alias("at"), "n", F.col("mean_score").alias("figure"))
    best = E.suggested_cut(s, GRID).join(m.select("feature", F.col("at").alias("cut"), "n"), ["feature", "cut"])
    best = best.select("feature", F.lit("suggested").alias("kind"), F.col("cut").alias("at"), "n", F.col("f1").alias("figure"))
    return m.unionByName(g).unionByName(best)


@query("a16_fair_accuracy", with_([*P_PAIRS, DOMAIN.cte()], f"""SELECT x.feature, count(*) AS n, {r('avg(CAST(p.ord = g.ord AS INT))')} AS exact, {r('avg(CAST(abs(p.ord-g.ord) <= 1 AS INT))')} AS within1, {r('avg(CAST((p.ord=0) = (g.ord=0) AS INT))')} AS presence
  FROM pairs x JOIN dom p ON p.feature = x.feature AND p.value = x.pred JOIN dom g ON g.feature = x.feature AND g.value = x.gold GROUP BY 1"""))
def a16(spark, sf):
    d = DOMAIN.small(spark)
    x = pairs(spark, sf).join(d.select("feature", F.col("value").alias("pred"), F.col("ord").alias("p_ord")), ["feature", "pred"]).join(
        d.select("feature", F.col("value").alias("gold"), F.col("ord").alias("g_ord")), ["feature", "gold"]
    )
    return E.fair_accuracy(x)


@query("a17_by_domain", with_(P_PAIRS, f"SELECT source, feature, count(*) AS n, count(*) FILTER (pred = gold) AS n_ok, {r('avg(CAST(pred = gold AS INT))')} AS accuracy FROM pairs GROUP BY 1, 2"))
def a17(spark, sf):
    return E.by_domain(pairs(spark, sf), ["source", "feature"])


@query("a18_scenario_matrix", with_(P_PAIRS, f"SELECT lang, feature, count(*) AS n, {r('avg(CAST(pred = gold AS INT))')} AS accuracy, CAST(grouping_id(lang, feature) AS INT) AS level FROM pairs GROUP BY CUBE (lang, feature)"))
def a18(spark, sf):
    p = pairs(spark, sf).withColumn("ok", F.col("pred") == F.col("gold"))
    return E.scenario_matrix(p, "lang", "feature")


C_TARGETS = """tg AS (SELECT doc_id, coalesce(grade_manual, grade, 'low') AS grade, coalesce(quality_manual, quality) AS quality, coalesce(toxic_manual, toxic) AS toxic FROM man)"""


def targets(spark, sf) -> DataFrame:
    m = manifest(spark, sf)
    return m.select("doc_id", F.coalesce("grade_manual", "grade", F.lit("low")).alias("grade"), F.coalesce("quality_manual", "quality").alias("quality"), F.coalesce("toxic_manual", "toxic").alias("toxic"))


def rarity_sql(c: str) -> str:
    return f"w_{c} AS (SELECT {c}, max(count(*)) OVER ()/count(*) AS w_{c} FROM tg GROUP BY 1)"


C_RARITY = ", ".join([rarity_sql("grade"), rarity_sql("quality"), rarity_sql("toxic")]) + f""",
 rar AS (SELECT doc_id, {r("least(15.0::DOUBLE, greatest(1.0::DOUBLE, w_grade, w_quality, w_toxic))")} AS weight FROM tg JOIN w_grade USING (grade) JOIN w_quality USING (quality) JOIN w_toxic USING (toxic))"""


@query("a19_rarity_weights", with_([C_MAN, C_TARGETS, C_RARITY], "SELECT doc_id, weight FROM rar"))
def a19(spark, sf):
    return P.rarity_weights(targets(spark, sf), CLASSES).select("doc_id", S.rnd(F.col("weight"), 6).alias("weight"))


@query("ml3_resample", with_([C_MAN, C_TARGETS, C_RARITY], """, c AS (SELECT doc_id, CAST(floor(weight*1e6 + 0.5) AS BIGINT) AS w FROM rar),
  k AS (SELECT doc_id, sum(w) OVER (ORDER BY doc_id) - w AS lo, sum(w) OVER (ORDER BY doc_id) AS hi FROM c),
  d AS (SELECT i AS draw, floor(('0x' || substr(md5('7|' || i), 1, 8))::UBIGINT / 4294967296.0::DOUBLE * (SELECT sum(w) FROM c)::DOUBLE) AS u FROM range(0, (SELECT count(*) FROM rar)) t(i))
  SELECT draw, doc_id FROM d JOIN k ON u >= lo AND u < hi"""))
def ml3(spark, sf):
    w = P.rarity_weights(targets(spark, sf), CLASSES).select("doc_id", S.rnd(F.col("weight"), 6).alias("weight"))
    return P.resample(w, "doc_id", "weight", w.count(), 7)


@query("a20_class_weights", with_([C_MAN, C_TARGETS, DOMAIN.cte()], f""", lg AS (SELECT 'grade' AS feature, grade AS value FROM tg UNION ALL SELECT 'quality', quality FROM tg UNION ALL SELECT 'toxic', toxic FROM tg),
 k AS (SELECT d.feature, d.value, count(lg.value) AS n FROM dom d LEFT JOIN lg USING (feature, value) GROUP BY 1, 2),
 s AS (SELECT *, 1/sqrt(greatest(n, 1)) AS rs, 1.0::DOUBLE/greatest(n, 1) AS ri FROM k)
 SELECT feature, value, n, {r("greatest(0.5::DOUBLE, least(4.0::DOUBLE, rs/avg(rs) OVER (PARTITION BY feature)))")} AS w_sqrt,
  {r("greatest(0.5::DOUBLE, least(4.0::DOUBLE, ri/avg(ri) OVER (PARTITION BY feature)))")} AS w_inv,
  {r("greatest(1.0::DOUBLE, least(15.0::DOUBLE, (sum(n) OVER (PARTITION BY feature) - n)/greatest(n, 1)))")} AS w_pos FROM s"""))
def a20(spark, sf):
    from pyspark.sql import Window as W

    t = targets(spark, sf).unpivot(["doc_id"], ["grade", "quality", "toxic"], "feature", "value")
    n = t.groupBy("feature", "value").agg(F.count("*").alias("n"))
    c = DOMAIN.small(spark).select("feature", "value").join(n, ["feature", "value"], "left").na.fill(0, ["n"])
    s = P.class_weights(c, "sqrt").withColumnRenamed("weight", "w_sqrt")
    s = P.class_weights(s, "inv").withColumnRenamed("weight", "w_inv")
    neg = F.sum("n").over(W.partitionBy("feature")) - F.col("n")
    return s.select("feature", "value", "n", S.rnd(F.col("w_sqrt"), 6).alias("w_sqrt"), S.rnd(F.col("w_inv"), 6).alias("w_inv"), S.rnd(P.pos_weight(F.col("n"), neg), 6).alias("w_pos"))


@query("a26_faithfulness", with_(P_STORE, f""", c AS (SELECT e.entity, CAST(a.value = e.value AS INT) AS s FROM store e JOIN store a USING (entity, feature) WHERE e.source = 'expert' AND a.source <> 'expert'),
  p AS (SELECT d.doc_id, count(c.s) AS c, coalesce(sum(c.s), 0) AS s FROM documents d LEFT JOIN c ON c.entity = d.doc_id GROUP BY 1)
  SELECT count(*) AS n_cases, sum(c) AS claims, sum(s) AS supported, {r('sum(s)/sum(c)')} AS micro, {r('avg(CASE WHEN c = 0 THEN 1.0::DOUBLE ELSE s/c END)')} AS macro, CASE WHEN sum(s)/sum(c) >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS gate FROM p"""))
def a26(spark, sf):
    m = manifest(spark, sf)
    agree = lambda a, g: F.struct((F.col(a) == F.col(g)).cast("int").alias("supported"))
    c = m.select(F.col("doc_id").alias("entity"), F.explode(F.array(agree("grade", "grade_manual"), agree("quality", "quality_manual"), agree("toxic", "toxic_manual"), agree("quality_third", "quality_manual"))).alias("x"))
    return E.faithfulness(c.select("entity", "x.supported").filter("supported is not null"), m.select(F.col("doc_id").alias("entity")))


@query("u1_union_datasets", """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS src FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, 'supplier' FROM supplier""")
def u1(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return L.union_datasets([(c, "customer"), (s, "supplier")])


@query("u6_unpivot_targets", f"""WITH u AS (SELECT 'l_quantity' AS target, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem)
  SELECT target, count(*) AS n, {r('avg(v)')} AS mean, min(v) AS lo, max(v) AS hi FROM u GROUP BY 1""")
def u6(spark, sf):
    u = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax").unpivot([], ["l_quantity", "l_discount", "l_tax"], "target", "v")
    return u.groupBy("target").agg(F.count("*").alias("n"), S.rnd(F.avg("v"), 6).alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))


SETS = {"en": "a", "fr": "b", "de": "c", "es": "d"}
C_MERGED = "u7l AS (" + " UNION ALL ".join(
    f"SELECT '{p}-' || doc_id AS id, CASE WHEN has_gold THEN quality_manual ELSE quality END AS quality, grade, CASE WHEN has_gold THEN toxic_manual END AS toxic FROM man WHERE lang = '{lang}'"
    for lang, p in SETS.items()
) + """), u7 AS (SELECT * FROM (SELECT id, 'quality' AS feature, quality AS value FROM u7l UNION ALL SELECT id, 'grade', grade FROM u7l UNION ALL SELECT id, 'toxic', toxic FROM u7l) WHERE value IS NOT NULL)"""


def merged_labels(spark, sf) -> DataFrame:
    m = manifest(spark, sf).withColumn("id", F.col("doc_id").cast("string"))
    core = lambda d: d.select("id", F.create_map(F.lit("quality"), F.col("quality"), F.lit("grade"), F.col("grade")).alias("labels"))
    extra = lambda d: d.filter("has_gold").select("id", F.create_map(F.lit("quality"), F.col("quality_manual"), F.lit("toxic"), F.col("toxic_manual")).alias("labels"))
    of = lambda lang: m.filter(F.col("lang") == lang)
    return L.merge_labels([(core(of(lang)), extra(of(lang)), p) for lang, p in SETS.items()])


@query("u7_merge_labels", with_([C_MAN, C_MERGED], "SELECT id, feature, value FROM u7"))
def u7(spark, sf):
    return merged_labels(spark, sf).select("id", F.explode("labels").alias("feature", "value")).filter("value is not null")


@query("u7_members", with_([C_MAN, C_MERGED, DOMAIN.cte()], "SELECT feature, ord, value, id FROM u7 JOIN dom USING (feature, value)"))
def u7_members(spark, sf):
    return L.members(merged_labels(spark, sf), DOMAIN.small(spark))


@query("u7_tags", with_([C_MAN, C_MERGED], "SELECT id, string_agg(substr(feature, 1, 1) || '-' || value, '__' ORDER BY CASE feature WHEN 'quality' THEN 0 WHEN 'grade' THEN 1 ELSE 2 END) AS tag FROM u7 GROUP BY 1"))
def u7_tags(spark, sf):
    tag = L.composite_tag(F.col("labels"), ["quality", "grade", "toxic"], {"quality": "q", "grade": "g", "toxic": "t"})
    return merged_labels(spark, sf).select("id", tag.alias("tag")).filter("tag <> ''")


@query("w1_stratified_split", with_([C_MAN], """, k AS (SELECT doc_id, has_gold, row_number() OVER (PARTITION BY has_gold ORDER BY md5('42|' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY has_gold) AS n FROM man)
  SELECT doc_id, CASE WHEN rn <= floor(n*f) THEN 'test' WHEN rn <= floor(n*f)+floor(n*f) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, CASE WHEN has_gold THEN 0.3::DOUBLE ELSE 0.05::DOUBLE END AS f FROM k)"""))
def w1(spark, sf):
    m = manifest(spark, sf).select("doc_id", "has_gold")
    return L.stratified_split(m, "doc_id", F.col("has_gold"), {True: (0.3, 0.3), False: (0.05, 0.05)}).select("doc_id", "split")


@query("w2_fresh_split", """WITH k AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents WHERE lang <> 'en')
  SELECT doc_id, CASE WHEN rn <= floor(n*0.1::DOUBLE) THEN 'test' WHEN rn <= floor(n*0.1::DOUBLE)+floor(n*0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM k
  UNION ALL SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'train' ELSE 'test' END FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lang = 'en'""")
def w2(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    fresh = L.stratified_split(d.filter("lang <> 'en'"), "doc_id", F.lit(1), {1: (0.1, 0.1)}).select("doc_id", "split")
    kept = d.filter("lang = 'en'").join(table(spark, sf, "labels").select("doc_id", F.lit("test").alias("split")), "doc_id", "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))
    return fresh.unionByName(kept)


QUOTAS = [("quality", "good", 20), ("quality", "poor", 20), ("grade", "mid", 15), ("toxic", "toxic", 25)]


@query("w9_quota_sample", "WITH RECURSIVE " + with_([C_MAN, """c AS (SELECT doc_id, md5('11|' || doc_id) AS h, [(quality IS NOT DISTINCT FROM 'good')::INT, (quality IS NOT DISTINCT FROM 'poor')::INT, (grade IS NOT DISTINCT FROM 'mid')::INT, (toxic IS NOT DISTINCT FROM 'toxic')::INT] AS cells FROM man),
  g AS (SELECT 0 AS pick, NULL::BIGINT AS doc_id, [20, 20, 15, 25] AS room, []::BIGINT[] AS seen
    UNION ALL SELECT pick, doc_id, room, seen FROM (SELECT g.pick + 1 AS pick, c.doc_id, list_transform(list_zip(g.room, c.cells), lambda z: greatest(z[1] - z[2], 0)) AS room, list_append(g.seen, c.doc_id) AS seen,
      list_sum(list_transform(list_zip(g.room, c.cells), lambda z: CASE WHEN z[1] > 0 THEN z[2] ELSE 0 END)) AS gain,
      row_number() OVER (ORDER BY list_sum(list_transform(list_zip(g.room, c.cells), lambda z: CASE WHEN z[1] > 0 THEN z[2] ELSE 0 END)) DESC, c.h, c.doc_id) AS rn
      FROM g JOIN c ON NOT list_contains(g.seen, c.doc_id) AND list_sum(c.cells) > 0 AND g.pick < 100) WHERE rn = 1 AND gain > 0),
  k AS (SELECT doc_id, pick FROM g WHERE pick > 0)"""], """SELECT doc_id, CAST(pick AS INT) AS pick, 'quota' AS picked_by FROM k
  UNION ALL SELECT doc_id, CAST(pick AS INT), 'fill' FROM (SELECT doc_id, (SELECT count(*) FROM k) + row_number() OVER (ORDER BY h, doc_id) AS pick FROM c WHERE doc_id NOT IN (SELECT doc_id FROM k)) WHERE pick <= 100""").removeprefix("WITH "))
def w9(spark, sf):
    m = manifest(spark, sf).select("doc_id", "quality", "grade", "toxic")
    return P.quota_sample(m, "doc_id", QUOTAS, 100)


@query("w10_exemplars", with_(P_PAIRS, """, c AS (SELECT p.entity, p.feature, p.gold, d.n_chars FROM pairs p JOIN documents d ON d.doc_id = p.entity WHERE pred = gold),
  a AS (SELECT entity FROM c WHERE feature = 'quality' AND gold = 'good' ORDER BY n_chars DESC, entity LIMIT 1),
  b AS (SELECT entity FROM c WHERE feature = 'grade' AND gold = 'high' AND entity NOT IN (FROM a) ORDER BY n_chars DESC, entity LIMIT 1),
  d AS (SELECT entity FROM c WHERE feature = 'quality' AND gold = 'poor' AND entity NOT IN (FROM a) AND entity NOT IN (FROM b) ORDER BY n_chars DESC, entity LIMIT 1)
  SELECT 0 AS target, entity::VARCHAR AS entity FROM a UNION ALL SELECT 1, entity::VARCHAR FROM b UNION ALL SELECT 2, entity::VARCHAR FROM d"""))
def w10(spark, sf):
    p = pairs(spark, sf).filter("pred = gold").join(table(spark, sf, "documents").select(F.col("doc_id").alias("entity"), "n_chars"), "entity")
    f, g = F.col("feature"), F.col("gold")
    t = F.when((f == "quality") & (g == "good"), 0).when((f == "grade") & (g == "high"), 1).when((f == "quality") & (g == "poor"), 2)
    return P.greedy_picks(p.withColumn("target", t).filter("target is not null"), "entity", [F.desc("n_chars")], 3)


@query("w11_picks", with_([C_MAN], """, a AS (SELECT doc_id FROM man WHERE (quality = 'good' OR quality_manual = 'good') AND (toxic = 'toxic' OR toxic_manual = 'toxic') ORDER BY doc_id LIMIT 1),
  b AS (SELECT doc_id FROM man WHERE (quality = 'good' OR quality_manual = 'good') AND doc_id NOT IN (FROM a) ORDER BY doc_id LIMIT 1),
  c AS (SELECT doc_id FROM man WHERE (grade = 'mid' OR grade_manual = 'mid') AND doc_id NOT IN (FROM a) AND doc_id NOT IN (FROM b) ORDER BY doc_id LIMIT 1)
  SELECT 0 AS target, doc_id::VARCHAR AS doc_id FROM a UNION ALL SELECT 1, doc_id::VARCHAR FROM b UNION ALL SELECT 2, doc_id::VARCHAR FROM c"""))
def w11(spark, sf):
    either = lambda c, v: (F.col(c) == v) | (F.coalesce(F.col(f"{c}_manual"), F.lit("")) == v)
    specs = [either("quality", "good") & either("toxic", "toxic"), either("quality", "good"), either("grade", "mid")]
    m = manifest(spark, sf).select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(specs)]))).alias("target"))
    return P.greedy_picks(m, "doc_id", [], len(specs))


@query("ml4_image_pool", "SELECT doc_id, source FROM documents WHERE NOT regexp_matches(lang || '/' || doc_id, 'de|/9')")
def ml4(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return P.name_pool(d, "de|/9", F.concat_ws("/", "lang", F.col("doc_id").cast("string"))).select("doc_id", "source")


@query("pr19_vocabulary", "SELECT p_brand AS feature, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS allowed FROM part GROUP BY 1")
def pr19(spark, sf):
    return L.vocabulary(table(spark, sf, "part"), "p_brand", "p_type").select("feature", F.array_join("allowed", ",").alias("allowed"))


@query("src9_incremental", """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders""")
def src9(spark, sf):
    """What is done keeps its own values; only the other keys come from the new run."""
    from sigweave.sources.files import incremental

    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    done = o.filter("o_orderdate < timestamp_ntz '1997-01-01'").select("o_orderkey", (F.col("o_custkey") + 1000000).alias("o_custkey"))
    return incremental(o.select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("src9_merge", """SELECT o_orderkey AS id, CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderkey % 2 = 0 THEN 'second' ELSE CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'first' ELSE 'second' END END AS origin,
  CAST(floor(o_totalprice*100 + 0.5) AS BIGINT) + CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderkey % 2 = 0 THEN 100 ELSE 0 END AS cents FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' OR o_orderdate >= TIMESTAMP '1996-01-01'""")
def src9_merge(spark, sf):
    """Two runs into one artefact: the second one changes rows of even id, adds later orders and leaves the rest; then it is
    repeated, which must change nothing."""
    from sigweave.sources.artefact import Artefact

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint").alias("cents"))
    first = o.filter("o_orderdate < timestamp_ntz '1997-01-01'").select("id", F.lit("first").alias("origin"), "cents")
    second = o.filter("o_orderdate >= timestamp_ntz '1997-01-01' or (o_orderdate >= timestamp_ntz '1996-01-01' and id % 2 = 0)")
    second = second.select("id", F.lit("second").alias("origin"), F.when(F.col("id") % 2 == 0, F.col("cents") + 100).otherwise(F.col("cents")).alias("cents"))
    store = Artefact(spark, scratch(spark, "artefact"), first.schema, "id", 16)
    store.merge(first, 1)
    store.merge(second, 2)
    store.merge(second.withColumn("cents", F.lit(0).cast("bigint")), 2)
    return store.read()
