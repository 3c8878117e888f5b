"""Allow or block pages by explicit host rules, else by an empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted per host, registered domain and suffix. Every level is a
beta-binomial whose prior is its parent's posterior mean, with a strength fitted by moments over all groups of the
level: suffix from the corpus, domain from its suffix, host from its domain. A page without a rule is blocked when the
upper bound (mean + z sd) of its host's posterior good rate stays below `threshold`.

Everything is DataFrame code: counts are combined before the only large exchange, levels above the host are tiny.

Defined results: a null url or one without `://` has empty host and path and falls to the corpus-wide posterior of the
empty host; without any label every prior is `prior_good` and pages are allowed; several labels of one page count once
(the smallest); repeated pages give repeated rows; null ids join no label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sigweave.session import cut

#: (verdict, host, path), given by the contract of the query
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def registered_domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _shrunk(level: DataFrame, max_strength: float) -> DataFrame:
    """Posterior a, b of each group from its counts k of n and its parent's mean `m`; one strength for the level.

    The level is stored, since its strength and its rows both come from it.
    """
    level = cut(level)
    spread = F.col("m") * (1 - F.col("m"))
    seen = F.col("n") > 0
    fit = level.select(
        F.sum(F.when(seen, F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2))).alias("s"),
        F.sum(F.when(seen, spread)).alias("e"),
        F.sum(F.when(seen, spread * (F.col("n") - 1))).alias("d"),
    )
    rho = F.when(F.col("d") > 0, (F.col("s") - F.col("e")) / F.col("d")).otherwise(0.0)
    rho = F.greatest(F.lit(1 / (1 + max_strength)), F.least(F.lit(0.5), rho))
    fit = fit.select((1 / rho - 1).alias("strength"))
    # one row: the strength of the level
    return level.join(F.broadcast(fit)).withColumns(
        {"a": F.col("k") + F.col("strength") * F.col("m"), "b": F.col("n") - F.col("k") + F.col("strength") * (1 - F.col("m"))}
    ).drop("strength")


def host_reputation(outcomes: DataFrame, prior_good: float = 0.9, prior_strength: float = 10.0, max_strength: float = 1000.0) -> DataFrame:
    """(host, n, good_rate, bound_sd) of every host in `outcomes(host, good)`; `good` null adds a host without counts."""
    h = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    h = cut(h.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))}))  # a row per host
    d = cut(h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    s = d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    top = s.select(
        ((F.coalesce(F.sum("k"), F.lit(0)) + prior_good * prior_strength) / (F.coalesce(F.sum("n"), F.lit(0)) + prior_strength)).alias("m")
    )
    mean = F.col("a") / (F.col("a") + F.col("b"))
    s = _shrunk(s.join(F.broadcast(top)), max_strength).select("suffix", mean.alias("m"))
    d = _shrunk(d.join(s, "suffix"), max_strength).select("domain", mean.alias("m"))
    h = _shrunk(h.join(d, "domain"), max_strength)
    total = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return h.select("host", "n", mean.alias("good_rate"), sd.alias("sd"))


def judge_pages(pages: DataFrame, labels: DataFrame, rules=RULES, z: float = 1.645, threshold: float = 0.75) -> DataFrame:
    """(page_id, host, path, rule, verdict, good_rate, upper) of every row of pages(page_id, url).

    labels(doc_id, quality) marks pages by id.
    """
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("good"))
    outcomes = p.select("page_id", "host").distinct().join(marks, "page_id", "left").select("host", "good")
    rep = host_reputation(outcomes).select("host", "good_rate", (F.col("good_rate") + z * F.col("sd")).alias("upper"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("upper") < threshold, "block").otherwise("allow")
    return p.join(rep, "host", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, judged).alias("verdict"),
        F.round("good_rate", 6).alias("good_rate"), F.round("upper", 6).alias("upper"),
    )


def op6_url_reputation(spark, sf_dir: str) -> DataFrame:
    from sigweave.session import table

    return judge_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


OP6_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), marks AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels GROUP BY 1
), outcomes AS (SELECT d.host, m.good FROM (SELECT DISTINCT page_id, host FROM p) d LEFT JOIN marks m USING (page_id)
), h0 AS (
  SELECT host, array_to_string(array_slice(string_split(host, '.'), -2, NULL), '.') AS domain,
         array_to_string(array_slice(string_split(host, '.'), -1, NULL), '.') AS suffix,
         count(good) AS n, coalesce(sum(good), 0) AS k FROM outcomes GROUP BY 1, 2, 3
), d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h0 GROUP BY 1, 2
), s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d0 GROUP BY 1
), top AS (SELECT (coalesce(sum(k), 0) + 9.0) / (coalesce(sum(n), 0) + 10.0) AS m FROM s0
), s1 AS (SELECT s0.*, m FROM s0, top
), sf AS (
  SELECT sum(CASE WHEN n > 0 THEN n * power(k / n - m, 2) END) AS s, sum(CASE WHEN n > 0 THEN m * (1 - m) END) AS e,
         sum(CASE WHEN n > 0 THEN m * (1 - m) * (n - 1) END) AS d FROM s1
), ss AS (SELECT 1 / greatest(1 / 1001.0, least(0.5, CASE WHEN d > 0 THEN (s - e) / d ELSE 0 END)) - 1 AS t FROM sf
), s2 AS (SELECT suffix, (k + t * m) / (n + t) AS m FROM s1, ss
), d1 AS (SELECT d0.*, s2.m FROM d0 JOIN s2 USING (suffix)
), df AS (
  SELECT sum(CASE WHEN n > 0 THEN n * power(k / n - m, 2) END) AS s, sum(CASE WHEN n > 0 THEN m * (1 - m) END) AS e,
         sum(CASE WHEN n > 0 THEN m * (1 - m) * (n - 1) END) AS d FROM d1
), ds AS (SELECT 1 / greatest(1 / 1001.0, least(0.5, CASE WHEN d > 0 THEN (s - e) / d ELSE 0 END)) - 1 AS t FROM df
), d2 AS (SELECT domain, (k + t * m) / (n + t) AS m FROM d1, ds
), h1 AS (SELECT h0.*, d2.m FROM h0 JOIN d2 USING (domain)
), hf AS (
  SELECT sum(CASE WHEN n > 0 THEN n * power(k / n - m, 2) END) AS s, sum(CASE WHEN n > 0 THEN m * (1 - m) END) AS e,
         sum(CASE WHEN n > 0 THEN m * (1 - m) * (n - 1) END) AS d FROM h1
), hs AS (SELECT 1 / greatest(1 / 1001.0, least(0.5, CASE WHEN d > 0 THEN (s - e) / d ELSE 0 END)) - 1 AS t FROM hf
), h2 AS (SELECT host, k + t * m AS a, n - k + t * (1 - m) AS b FROM h1, hs
), rep AS (SELECT host, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS up FROM h2
), r AS (
  SELECT p.*, up, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p LEFT JOIN rep USING (host)
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN up < 0.75 THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
