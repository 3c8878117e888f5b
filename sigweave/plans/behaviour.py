"""Signal and rule-inference queries over `events`: one entity per user, one signal per event type."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigweave.functions import scores as S
from sigweave.operators import inference as I
from sigweave.operators import signals as G
from sigweave.operators.percentile import exact_percentiles
from sigweave.plans import kb
from sigweave.plans.base import query, r, with_
from sigweave.session import cut, table


class Behaviour:
    """Lazily built chain signals -> readings -> votes -> rules -> ranking."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    @cached_property
    def sig(self) -> DataFrame:
        ev = table(self.spark, self.sf, "events").select("user_id", "event_type", "value", "props")
        cents = F.floor(F.col("value") * 100 + F.lit(0.5))
        k = F.get_json_object("props", "$.k").cast("bigint")
        mean_k = F.col("k") / F.col("n_obs")
        # Five steps read the signals with different columns; materialising this
        # per-user table once keeps the big `events` table at a single scan.
        return cut(G.collect_signals(
            ev,
            "user_id",
            "event_type",
            kb.FEATURE_NAMES,
            {"cents": cents, "k": k},
            {
                "value": F.when(mean_k < 45, "low").when(mean_k <= 54, "mid").otherwise("high"),
                "severity": F.least(F.lit(1.0), F.floor(F.col("cents") / F.col("n_obs") + F.lit(0.5)) / F.lit(10000.0)),
            },
        ))

    @cached_property
    def entities(self) -> DataFrame:
        return self.sig.select("entity").distinct()

    @cached_property
    def curves(self) -> DataFrame:
        return G.calibrate(self.sig, kb.CURVED)

    @cached_property
    def freq(self) -> DataFrame:
        return G.value_freq(self.sig, kb.CATEGORICAL)

    @cached_property
    def read(self) -> DataFrame:
        # Votes, rules, findings and reports all read this; the rank expression is
        # evaluated once here instead of being inlined into each of them. The sign's
        # wording is joined back by broadcast rather than stored with every row.
        signs = kb.FEATURES.small(self.spark)
        r = G.readings(self.sig, signs, self.curves, self.freq)
        return cut(r.select("entity", "feature", "value", "n_obs", "severity", "rel", "mentioned")).join(signs, "feature")

    @cached_property
    def present(self) -> DataFrame:
        return I.present_features(self.read)

    @cached_property
    def vote_rows(self) -> DataFrame:
        return I.vote_rows(self.read, kb.VOTES.small(self.spark))

    @cached_property
    def votes(self) -> DataFrame:
        return I.tally(self.vote_rows)

    @cached_property
    def fired(self) -> DataFrame:
        return I.fire_rules(self.present, kb.RULE_CONDITIONS.small(self.spark), kb.RULE_NEEDS.small(self.spark))

    @cached_property
    def scores(self) -> DataFrame:
        base = self.vote_rows.filter(F.col("outcome") != I.BALANCED).select("entity", "outcome", F.col("weight").alias("score"))
        return I.apply_rules(base, self.fired, kb.RULE_BOOSTS.small(self.spark))

    @cached_property
    def ranked(self) -> DataFrame:
        return I.rank_outcomes(self.scores, self.entities)

    @cached_property
    def found(self) -> DataFrame:
        return I.findings(self.read, kb.PHRASES.small(self.spark), kb.CAVEAT)

    @cached_property
    def ranked_once(self) -> DataFrame:
        """The ranking materialised, for steps that read it more than once."""
        return cut(self.ranked)

    @cached_property
    def found_once(self) -> DataFrame:
        return cut(self.found)


# ---- SQL text of the same chain -----------------------------------------------------------

C_SIG = """ev AS (SELECT user_id, event_type, CAST(floor(value*100+0.5) AS BIGINT) AS cents,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
  WHERE event_type IN ('click','view','purchase','error','signup')),
sig AS (SELECT user_id AS entity, event_type AS feature, count(*) AS n_obs,
  CASE WHEN sum(k)/count(*) < 45 THEN 'low' WHEN sum(k)/count(*) <= 54 THEN 'mid' ELSE 'high' END AS value,
  least(1.0::DOUBLE, floor(sum(cents)/count(*) + 0.5)/10000.0::DOUBLE) AS severity
  FROM ev GROUP BY 1, 2)"""
C_CURVES = (
    "curves AS (SELECT feature, count(*) AS n, " + r("avg(severity)") + " AS mean, "
    "list_transform(quantile_cont(severity, [0,0.05,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95,1]), lambda x: "
    + r("x")
    + ") AS q FROM sig WHERE feature IN ('click','view','purchase') GROUP BY 1)"
)
C_FREQ = """freq AS (SELECT feature, value, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY feature) AS freq
  FROM sig WHERE feature = 'error' GROUP BY 1, 2)"""


def curve_sql(sev: str, q: str) -> str:
    i = f"len(list_filter({q}[2:], lambda x: x < {sev}))"
    inner = r(
        f"({i} + CASE WHEN {q}[{i}+2] <= {q}[{i}+1] THEN 0.0 ELSE ({sev}-{q}[{i}+1])/({q}[{i}+2]-{q}[{i}+1]) END)*5.0::DOUBLE/100.0::DOUBLE", 4
    )
    absolute = r(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({sev}-0.3::DOUBLE)/0.7::DOUBLE))", 4)
    return (
        f"CASE WHEN {sev} < 0.12 THEN 0.0 WHEN {q} IS NULL OR {q}[21] < 0.2 THEN {absolute} "
        f"WHEN {i} >= 20 THEN 1.0 ELSE greatest(0.0::DOUBLE, {inner}) END"
    )


C_READ = f"""rd0 AS (SELECT s.*, f.kind, f.default_value, f.tier_word, f.reliability, f.trust, f.tier, f.label, c.q, fr.freq
  FROM sig s JOIN features f USING (feature) LEFT JOIN curves c USING (feature)
  LEFT JOIN freq fr ON fr.feature = s.feature AND fr.value = s.value),
rd1 AS (SELECT * EXCLUDE (q, freq), CASE WHEN kind IN ('graded','extra') THEN {curve_sql('severity', 'q')}
  WHEN kind = 'categorical' THEN {r('greatest(0.1::DOUBLE, 1.0::DOUBLE - coalesce(freq, 0.3::DOUBLE))')} ELSE severity END AS rel FROM rd0),
rd AS (SELECT *, CASE WHEN kind IN ('graded','extra') THEN rel >= 0.6 WHEN kind = 'categorical' THEN true ELSE severity >= 0.5 END AS mentioned FROM rd1)"""
C_PRESENT = """present AS (SELECT entity, feature, CASE WHEN kind IN ('graded','categorical') THEN value ELSE 'present' END AS value
  FROM rd WHERE kind IN ('graded','categorical') OR severity >= 0.5)"""
C_VOTES = """vrows AS (SELECT r.entity, r.feature, v.value, v.outcome,
    v.weight * CASE WHEN r.kind = 'extra' THEN r.rel * r.reliability ELSE r.rel END AS weight
  FROM rd r JOIN votes v ON v.feature = r.feature AND v.value = CASE WHEN r.kind = 'categorical' THEN r.value ELSE 'present' END
  WHERE r.mentioned),
tally AS (SELECT entity, outcome, sum(weight) AS score FROM vrows WHERE outcome <> 'balanced' GROUP BY 1, 2)"""
C_FIRED = """fired AS (SELECT p.entity, n.rule_id, n.rule_ord FROM (SELECT DISTINCT entity FROM present) p CROSS JOIN rule_needs n
  WHERE n.enabled = 1
  AND n.n_when = (SELECT count(DISTINCT c.feature) FROM rule_conditions c JOIN present q ON q.feature = c.feature AND q.value = c.value
                  WHERE c.rule_id = n.rule_id AND c.grp = 'when' AND q.entity = p.entity)
  AND (n.n_any = 0 OR EXISTS (SELECT 1 FROM rule_conditions c JOIN present q ON q.feature = c.feature AND q.value = c.value
                  WHERE c.rule_id = n.rule_id AND c.grp = 'any' AND q.entity = p.entity)))"""
C_SCORES = """fold AS (SELECT f.entity, b.outcome, f.rule_ord, b.delta FROM fired f JOIN rule_boosts b USING (rule_id)),
keys AS (SELECT entity, outcome FROM tally UNION SELECT entity, outcome FROM fold),
base AS (SELECT k.entity, k.outcome, coalesce(t.score, 0.0) AS b FROM keys k LEFT JOIN tally t USING (entity, outcome)),
walk AS (SELECT f.entity, f.outcome, b.b + sum(f.delta) OVER (PARTITION BY f.entity, f.outcome ORDER BY f.rule_ord) AS s,
   row_number() OVER (PARTITION BY f.entity, f.outcome ORDER BY f.rule_ord DESC) AS back
   FROM fold f JOIN base b USING (entity, outcome)),
folded AS (SELECT entity, outcome, max(CASE WHEN back = 1 THEN s END) - least(0.0, min(s)) AS s FROM walk GROUP BY 1, 2),
scores AS (SELECT b.entity, b.outcome, coalesce(f.s, b.b) AS score FROM base b LEFT JOIN folded f USING (entity, outcome))"""
C_RANKED = f"""rk AS (SELECT entity, outcome, s9 AS score, max(s9) OVER (PARTITION BY entity) AS best,
   row_number() OVER (PARTITION BY entity ORDER BY s9 DESC, outcome) AS rk
   FROM (SELECT entity, outcome, {r('score', 9)} AS s9 FROM scores)),
ents AS (SELECT DISTINCT entity FROM sig),
best AS (SELECT e.entity, coalesce(k.best, 0.0) AS best FROM ents e LEFT JOIN rk k ON k.entity = e.entity AND k.rk = 1),
ranked AS (SELECT entity, outcome, {r('score/(score+1.2)')} AS confidence, CAST(rk + CASE WHEN best < 0.55 THEN 1 ELSE 0 END AS INT) AS rank FROM rk WHERE rk <= 3
  UNION ALL SELECT entity, 'balanced', {r('1.0 - best/0.55')}, 1 FROM best WHERE best < 0.55)"""

P_READ = [kb.FEATURES.cte(), C_SIG, C_CURVES, C_FREQ, C_READ]
P_PRESENT = [*P_READ, C_PRESENT]
P_VOTES = [*P_READ, kb.VOTES.cte(), C_VOTES]
P_FIRED = [*P_PRESENT, kb.RULE_NEEDS.cte(), kb.RULE_CONDITIONS.cte(), C_FIRED]
P_RANKED = [*P_FIRED, kb.RULE_BOOSTS.cte(), kb.VOTES.cte(), C_VOTES, C_SCORES, C_RANKED]
C_FOUND = f"""phr AS (SELECT r.*, max(CASE WHEN feature = 'error' AND value = 'high' THEN 1 ELSE 0 END) OVER (PARTITION BY entity) AS both_ FROM rd r),
fnd AS (SELECT p.*, CASE WHEN p.feature = 'click' AND both_ = 1 THEN 'clicks possibly caused by errors'
    ELSE coalesce((SELECT phrase FROM phrases x WHERE x.feature = p.feature AND x.value = p.value),
                  (SELECT phrase FROM phrases x WHERE x.feature = p.feature AND x.value = '*')) END AS phrase,
  (p.feature = 'click' AND both_ = 1) AS doubted, {r('rel*trust')} AS prominence
  FROM phr p WHERE CASE WHEN kind = 'categorical' THEN value <> default_value ELSE mentioned END),
found AS (SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY tier, prominence DESC, feature) AS INT) AS pos, feature, value, phrase, tier, prominence, doubted, rel, label
  FROM fnd WHERE phrase IS NOT NULL)"""
P_FOUND = [*P_READ, kb.PHRASES.cte(), C_FOUND]
P_BOTH = [*P_RANKED, kb.PHRASES.cte(), C_FOUND]


# ---- registered queries -------------------------------------------------------------------


@query(
    "a6_calibrate",
    with_([C_SIG, C_CURVES], "SELECT feature, n, mean, CAST(i-1 AS INT) AS step, q[i] AS point FROM curves, range(1, 22) t(i)"),
)
def a6(spark, sf):
    c = Behaviour(spark, sf).curves
    return c.select("feature", "n", "mean", F.posexplode("q").alias("step", "point"))


@query("a6_exact_percentiles", f"""WITH x AS (SELECT 'value:' || event_type AS feature, value AS v FROM events UNION ALL SELECT 'price:' || l_returnflag, l_extendedprice*(1-l_discount) FROM lineitem),
  p AS (SELECT feature, quantile_cont(v, [s/20.0 for s in range(0, 21)]) AS q FROM x GROUP BY 1)
  SELECT feature, CAST(i - 1 AS INT) AS step, {r('q[i]', 6)} AS point FROM p, range(1, 22) t(i)""")
def a6x(spark, sf):
    """Percentile curves of raw doubles, with no bound on how many distinct ones a group has."""
    e = table(spark, sf, "events").select(F.concat(F.lit("value:"), "event_type").alias("feature"), F.col("value").alias("v"))
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("price:"), "l_returnflag").alias("feature"), (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("v"))
    p = exact_percentiles(e.unionByName(li), ["feature"], "v", [s / 20.0 for s in range(21)])
    return p.select("feature", F.round(F.col("share") * 20).cast("int").alias("step"), S.rnd(F.col("value"), 6).alias("point"))


@query("w8_cat_weight", with_([C_SIG, C_FREQ], f"""SELECT s.entity, s.feature, s.value, {r('greatest(0.1::DOUBLE, 1.0::DOUBLE - coalesce(f.freq, 0.3::DOUBLE))')} AS rel
  FROM sig s LEFT JOIN freq f USING (feature, value) WHERE s.feature = 'error'"""))
def w8(spark, sf):
    b = Behaviour(spark, sf)
    return G.cat_weight(b.sig.filter("feature = 'error'"), b.freq).select("entity", "feature", "value", "rel")


@query("w7_pctl_rank", with_([C_SIG, C_CURVES], f"SELECT entity, feature, severity, {curve_sql('severity', 'q')} AS rel FROM sig LEFT JOIN curves USING (feature)"))
def w7(spark, sf):
    b = Behaviour(spark, sf)
    return G.pctl_rank(b.sig, b.curves).select("entity", "feature", "severity", "rel")


@query("j8_curve_interval", with_([C_SIG, C_CURVES], """, pts AS (SELECT feature, CAST(i-1 AS INT) AS step, q[i] AS lo, q[i+1] AS hi FROM curves, range(1, 21) t(i))
  SELECT s.entity, s.feature, s.severity, p.step, p.lo, p.hi FROM sig s JOIN pts p ON p.feature = s.feature AND s.severity > p.lo AND s.severity <= p.hi"""))
def j8(spark, sf):
    b = Behaviour(spark, sf)
    q = F.col("q")
    # At most 20 intervals per curve and len(CURVED) curves: a bounded broadcast.
    iv = b.curves.select("feature", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct(i.alias("step"), F.get(q, i).alias("lo"), F.get(q, i + 1).alias("hi")))).alias("i")).select("feature", "i.*")
    return b.sig.join(F.broadcast(iv), "feature").filter("severity > lo and severity <= hi").select("entity", "feature", "severity", "step", "lo", "hi")


@query("j5_vote_rows", with_(P_VOTES, f"SELECT entity, feature, value, outcome, {r('weight')} AS weight FROM vrows"))
def j5(spark, sf):
    return Behaviour(spark, sf).vote_rows.withColumn("weight", S.rnd(F.col("weight"), 6))


@query("j7_band", with_(P_READ, """SELECT entity, feature, rel, CASE WHEN rel <= 0.25 THEN 'slight' WHEN rel <= 0.5 THEN 'moderate' WHEN rel <= 0.75 THEN 'marked' ELSE 'strong' END AS band FROM rd"""))
def j7(spark, sf):
    return Behaviour(spark, sf).read.select("entity", "feature", "rel", S.first_band(F.col("rel"), kb.BANDS).alias("band"))


@query("j6_fire_rules", with_(P_FIRED, "SELECT entity, rule_id, rule_ord FROM fired"))
def j6(spark, sf):
    return Behaviour(spark, sf).fired


@query("a8_tally", with_(P_VOTES, f"SELECT entity, outcome, {r('score')} AS score FROM tally"))
def a8(spark, sf):
    return Behaviour(spark, sf).votes.withColumn("score", S.rnd(F.col("score"), 6))


@query("a9_apply_rules", with_(P_RANKED, f"SELECT entity, outcome, {r('score')} AS score FROM scores"))
def a9(spark, sf):
    return Behaviour(spark, sf).scores.withColumn("score", S.rnd(F.col("score"), 6))


@query("t1_rank_outcomes", with_(P_RANKED, "SELECT entity, outcome, confidence, rank FROM ranked"))
def t1(spark, sf):
    return Behaviour(spark, sf).ranked


@query("t2_findings", with_(P_FOUND, "SELECT entity, pos, feature, value, phrase, tier, prominence, doubted FROM found"))
def t2(spark, sf):
    return Behaviour(spark, sf).found.drop("rel", "label")


@query("t3_headline", with_(P_RANKED, f""", b AS (SELECT e.entity, (SELECT struct_pack(r := rel, l := label, f := feature) FROM rd x WHERE x.entity = e.entity AND mentioned ORDER BY rel DESC, label DESC LIMIT 1) AS b,
   (SELECT outcome FROM ranked k WHERE k.entity = e.entity AND rank = 1) AS lead FROM ents e),
 h AS (SELECT *, CAST(floor(b.r*100+0.5) AS INT) AS p FROM b)
 SELECT entity, CASE WHEN b IS NULL THEN 'close to balanced' ELSE 'stands out: ' || lower(b.l) ||
   CASE WHEN b.f NOT IN ('click','view','purchase') THEN '' WHEN p >= 85 THEN ' - more pronounced than ~' || p || '% of entities'
        WHEN p >= 70 THEN ' - more pronounced than most (top ~' || (100-p) || '%)' ELSE '' END ||
   CASE WHEN lead = 'balanced' THEN '' ELSE '; leans toward ' || lead END END AS headline FROM h"""))
def t3(spark, sf):
    b = Behaviour(spark, sf)
    return I.headline(b.read, b.ranked, kb.CURVED)


@query("t4_highlights", with_(P_READ, """SELECT entity, CAST(rank AS INT) AS rank, feature, rel, score FROM (SELECT entity, feature, rel, CAST(floor(severity*100+0.5) AS INT) AS score,
  row_number() OVER (PARTITION BY entity ORDER BY rel DESC, feature) AS rank FROM rd WHERE kind <> 'categorical' AND rel > 0.15) WHERE rank <= 3"""))
def t4(spark, sf):
    return I.highlights(Behaviour(spark, sf).read)


@query("t6_recommend", with_([*P_BOTH, kb.ACTIONS.cte(), kb.FALLBACK.cte(), kb.AVOID.cte()], """, a0 AS (SELECT entity, pos, coalesce((SELECT action FROM actions x WHERE x.feature = f.feature AND x.value = f.value),
    (SELECT action FROM actions x WHERE x.feature = f.feature AND x.value = '*')) AS action FROM found f WHERE NOT doubted),
 a1 AS (SELECT entity, action, min(pos) AS pos FROM a0 WHERE action IS NOT NULL GROUP BY 1, 2),
 a2 AS (SELECT entity, action, row_number() OVER (PARTITION BY entity ORDER BY pos) AS pos FROM a1)
 SELECT entity, 'do' AS kind, CAST(pos AS INT) AS pos, action FROM a2 WHERE pos <= 3
 UNION ALL SELECT k.entity, 'do', f.pos, f.action FROM ranked k JOIN fallback f ON f.outcome = k.outcome AND f.pos <= 2
   WHERE k.rank = 1 AND k.outcome <> 'balanced' AND k.entity NOT IN (SELECT entity FROM a2)
 UNION ALL SELECT k.entity, 'avoid', v.pos, v.action FROM ranked k JOIN avoid v ON v.outcome = k.outcome AND v.pos <= 2 WHERE k.rank = 1"""))
def t6(spark, sf):
    b = Behaviour(spark, sf)
    return I.recommend(b.found_once, b.ranked_once, kb.ACTIONS.small(spark), kb.FALLBACK.small(spark), kb.AVOID.small(spark))


@query("j16_attribute", with_([*P_BOTH, kb.EFFECTS.cte(), kb.OUTCOME_EFFECTS.cte()], """, f4 AS (SELECT * FROM found WHERE pos <= 4 AND NOT doubted),
 o AS (SELECT f.entity, f.pos AS a, e.pos AS b, e.item FROM f4 f JOIN effects e ON e.feature = f.feature AND
    (e.value = f.value OR (e.value = '*' AND NOT EXISTS (SELECT 1 FROM effects z WHERE z.feature = f.feature AND z.value = f.value)))),
 own AS (SELECT entity, lower(item) AS key, a, b, item FROM (SELECT *, row_number() OVER (PARTITION BY entity, lower(item) ORDER BY a, b, item) AS rn FROM o) WHERE rn = 1),
 ext AS (SELECT k.entity, lower(x.item) AS key, 99 AS a, x.pos AS b, x.item FROM ranked k JOIN outcome_effects x ON x.outcome = k.outcome
    WHERE k.rank = 1 AND (SELECT count(*) FROM own w WHERE w.entity = k.entity) < 4
    AND NOT EXISTS (SELECT 1 FROM own w WHERE w.entity = k.entity AND w.key = lower(x.item))),
 al AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY a, b, key) AS pos FROM (SELECT * FROM own UNION ALL SELECT * FROM ext))
 SELECT entity, CAST(pos AS INT) AS pos, item, CASE WHEN a = 99 THEN 'outcome' ELSE 'sign' END AS origin FROM al WHERE (a < 99 AND pos <= 10) OR (a = 99 AND pos <= 6)"""))
def j16(spark, sf):
    b = Behaviour(spark, sf)
    return I.attribute(b.found_once, b.ranked_once, kb.EFFECTS.small(spark), kb.OUTCOME_EFFECTS.small(spark))


@query("g13_explain", with_([*P_RANKED, kb.RULE_NOTES.cte()], """SELECT k.entity, k.outcome, k.rank, coalesce((SELECT string_agg(n.note, ' | ' ORDER BY f.rule_ord) FROM fired f
   JOIN rule_boosts b ON b.rule_id = f.rule_id AND b.outcome = k.outcome AND b.delta > 0 JOIN rule_notes n ON n.rule_id = f.rule_id AND n.note <> ''
   WHERE f.entity = k.entity), '') AS why FROM ranked k"""))
def g13(spark, sf):
    b = Behaviour(spark, sf)
    return I.explain(b.ranked, b.fired, kb.RULE_BOOSTS.small(spark), kb.RULE_NOTES.small(spark))


@query("t8_match_cards", with_([*P_PRESENT, kb.CARD_CONDITIONS.cte(), kb.CARD_SIZES.cte()], """SELECT entity, card_id, n_cond AS specificity,
  CAST(row_number() OVER (PARTITION BY entity ORDER BY n_cond DESC, card_id) AS INT) AS rank FROM (
  SELECT p.entity, c.card_id, count(*) AS hits FROM present p JOIN card_conditions c ON c.feature = p.feature AND c.value = p.value GROUP BY 1, 2) JOIN card_sizes USING (card_id) WHERE hits = n_cond"""))
def t8(spark, sf):
    b = Behaviour(spark, sf)
    return I.match_cards(b.present, kb.CARD_CONDITIONS.small(spark), kb.CARD_SIZES.small(spark))


@query("a32_balance_score", with_(P_READ, f"""SELECT entity, CAST(greatest(40, least(99, floor(100.0::DOUBLE - 22.0::DOUBLE*d + 0.5))) AS INT) AS balance FROM (
  SELECT entity, {r("sum(CASE WHEN kind = 'categorical' THEN CASE WHEN value <> default_value THEN rel*0.5 ELSE 0.0 END ELSE rel END)", 9)} AS d FROM rd GROUP BY 1)"""))
def a32(spark, sf):
    return I.balance_score(Behaviour(spark, sf).read)


@query("pr10_present_features", with_(P_PRESENT, "SELECT entity, feature, value FROM present"))
def pr10(spark, sf):
    return Behaviour(spark, sf).present


@query("pr12_notable", with_(P_READ, "SELECT entity, feature, value, rel FROM rd WHERE CASE WHEN kind = 'categorical' THEN value <> default_value ELSE rel >= 0.6 OR (kind = 'zone' AND severity >= 0.5) END"))
def pr12(spark, sf):
    return G.notable(Behaviour(spark, sf).read).select("entity", "feature", "value", "rel")


@query("pr13_pctl_phrase", with_(P_READ, """SELECT entity, feature, CASE WHEN kind NOT IN ('graded','extra') THEN '' WHEN p >= 85 THEN 'more pronounced than ~' || p || '% of entities'
  WHEN p >= 70 THEN 'more pronounced than most (top ~' || (100-p) || '%)' ELSE '' END AS phrase FROM (SELECT *, CAST(floor(rel*100+0.5) AS INT) AS p FROM rd)"""))
def pr13(spark, sf):
    b = Behaviour(spark, sf)
    return b.read.select("entity", "feature", S.percentile_phrase(F.col("rel"), F.col("feature").isin(kb.CURVED)).alias("phrase"))


@query("pr20_summary_lines", with_([kb.FEATURES.cte(), C_SIG], """SELECT entity, string_agg(line, '; ' ORDER BY line) AS summary FROM (
  SELECT entity, f.label || ': ' || value || ' (' || CAST(floor(severity*100+0.5) AS INT) || '%)' AS line FROM sig JOIN features f USING (feature)) GROUP BY 1"""))
def pr20(spark, sf):
    return G.summary_lines(Behaviour(spark, sf).sig, kb.FEATURES.small(spark))


@query("pr5_derive_axes", with_([C_SIG], """, p AS (SELECT entity, sum(CASE WHEN feature IN ('click','view') THEN n_obs ELSE 0 END) AS a, sum(CASE WHEN feature IN ('purchase','error') THEN n_obs ELSE 0 END) AS b,
    sum(CASE WHEN feature = 'signup' THEN n_obs ELSE 0 END) AS c FROM sig GROUP BY 1),
 q AS (SELECT entity, b/(a+b+c) AS p2, c/(a+b+c) AS p3 FROM p),
 ax AS (SELECT entity, 'thickness' AS axis, CASE WHEN p3 > 0.5 THEN 'thick' ELSE 'thin' END AS value, p3 AS p FROM q
   UNION ALL SELECT entity, 'texture', CASE WHEN p2+p3 > 0.5 THEN 'greasy' ELSE 'smooth' END, p2+p3 FROM q)
 SELECT entity, axis, value, """ + r("CASE WHEN p > 0.5 THEN p ELSE 1.0::DOUBLE - p END") + " AS confidence, " + r("p") + " AS severity FROM ax"))
def pr5(spark, sf):
    s = Behaviour(spark, sf).sig
    n = lambda fs: F.sum(F.when(F.col("feature").isin(fs), F.col("n_obs")).otherwise(F.lit(0)))
    c = s.groupBy("entity").agg(n(["click", "view"]).alias("a"), n(["purchase", "error"]).alias("b"), n(["signup"]).alias("c"))
    tot = F.col("a") + F.col("b") + F.col("c")
    p = c.select("entity", (F.col("a") / tot).alias("p1"), (F.col("b") / tot).alias("p2"), (F.col("c") / tot).alias("p3"))
    return G.derive_axes(p).select("entity", "axis", "value", S.rnd(F.col("confidence"), 6).alias("confidence"), S.rnd(F.col("severity"), 6).alias("severity"))


@query("f19_list_phrase", with_(P_FOUND, """, l AS (SELECT e.entity, list(f.phrase ORDER BY f.pos) FILTER (f.pos <= 4) AS p FROM (SELECT DISTINCT entity FROM sig) e LEFT JOIN found f USING (entity) GROUP BY 1)
 SELECT entity, CASE WHEN p IS NULL OR len(p) = 0 THEN 'no single sign stands out' WHEN len(p) = 1 THEN p[1]
   ELSE array_to_string(p[1:len(p)-1], ', ') || ' and ' || p[len(p)] END AS text FROM l"""))
def f19(spark, sf):
    b = Behaviour(spark, sf)
    return I.findings_text(b.found, b.entities)


@query("f20_certainty_note", with_(P_READ, """SELECT entity, coalesce(string_agg(DISTINCT lower(label), ', ' ORDER BY lower(label)) FILTER (mentioned AND tier_word = 'tentative'), '') AS tentative FROM rd GROUP BY 1"""))
def f20(spark, sf):
    return I.certainty_note(Behaviour(spark, sf).read)


@query("f21_render_lines", with_(P_BOTH, """SELECT k.entity, 'signs: ' || coalesce((SELECT string_agg(phrase, ', ' ORDER BY pos) FROM found f WHERE f.entity = k.entity), 'none') || ' / outcomes: ' ||
  string_agg(k.rank || '. ' || k.outcome || ' ' || CAST(floor(k.confidence*100+0.5) AS INT) || '%', ', ' ORDER BY k.rank) AS report FROM ranked k GROUP BY k.entity"""))
def f21(spark, sf):
    b = Behaviour(spark, sf)
    return I.render_lines(b.ranked, b.found)


@query("f24_reliability", with_(P_READ, f"""SELECT entity, feature, CASE tier_word WHEN 'reliable' THEN 'clear read' WHEN 'moderate' THEN '' ELSE 'worth confirming' END AS wording,
  {r('rel*reliability')} AS vote_factor FROM rd"""))
def f24(spark, sf):
    word = F.when(F.col("tier_word") == "reliable", "clear read").when(F.col("tier_word") == "moderate", "").otherwise("worth confirming")
    return Behaviour(spark, sf).read.select("entity", "feature", word.alias("wording"), S.rnd(F.col("rel") * F.col("reliability"), 6).alias("vote_factor"))


@query("j15_attach_dim", with_([*P_RANKED, kb.BASELINE.cte()], "SELECT k.entity, k.outcome, b.baseline_class, b.outcome IS NULL AS missed FROM ranked k LEFT JOIN baseline b USING (outcome)"))
def j15(spark, sf):
    d = kb.BASELINE.small(spark).withColumn("_hit", F.lit(True))
    return Behaviour(spark, sf).ranked.join(d, "outcome", "left").select("entity", "outcome", "baseline_class", F.col("_hit").isNull().alias("missed"))


@query("a5_complete_absent", with_([C_SIG], """, obs AS (SELECT entity, CASE WHEN feature IN ('click','view') THEN 'activity' ELSE feature END AS feature, value, CASE feature WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS class_id
   FROM sig WHERE severity >= 0.5),
 seen AS (SELECT entity, feature, arg_max(value, class_id) AS value FROM obs GROUP BY 1, 2),
 spine AS (SELECT entity, f AS feature FROM (SELECT DISTINCT entity FROM sig) CROSS JOIN (VALUES ('activity'), ('purchase'), ('error'), ('signup')) d(f))
 SELECT entity, feature, value FROM seen UNION ALL SELECT entity, feature, 'absent' FROM spine WHERE (entity, feature) NOT IN (SELECT (entity, feature) FROM seen)"""))
def a5(spark, sf):
    b = Behaviour(spark, sf)
    f = F.col("feature")
    obs = b.sig.filter("severity >= 0.5").select(
        "entity",
        F.when(f.isin("click", "view"), "activity").otherwise(f).alias("feature"),
        "value",
        F.when(f == "click", 1).when(f == "view", 2).otherwise(3).alias("class_id"),
    )
    return I.complete_absent(obs, b.entities, ["activity", "purchase", "error", "signup"])


@query("u3_missing_domain", with_([C_SIG], "SELECT e.entity, d.f AS feature FROM (SELECT DISTINCT entity FROM sig) e CROSS JOIN (VALUES ('click'), ('view'), ('purchase'), ('error'), ('signup')) d(f) EXCEPT SELECT entity, feature FROM sig WHERE severity >= 0.45"))
def u3(spark, sf):
    b = Behaviour(spark, sf)
    return I.missing_domain(b.sig.filter("severity >= 0.45"), b.entities, kb.FEATURE_NAMES)


# Proposals stand in for an external matcher: each surfaced sign proposes every
# outcome whose name shares its initial or the outcome after it in the alphabet.
C_PROP = """prop AS (SELECT entity, CASE feature WHEN 'click' THEN 'growth' WHEN 'view' THEN 'dormant' WHEN 'purchase' THEN 'loyalty' WHEN 'error' THEN 'churn' ELSE 'unknown' END AS outcome,
   CASE WHEN value = 'mid' THEN 'signup' WHEN value = 'low' THEN feature || ' on tip' ELSE feature END AS feature, CASE WHEN value = 'high' THEN NULL ELSE severity*2 END AS confidence FROM sig)"""


def proposals(b: Behaviour) -> DataFrame:
    f, v = F.col("feature"), F.col("value")
    o = F.when(f == "click", "growth").when(f == "view", "dormant").when(f == "purchase", "loyalty").when(f == "error", "churn").otherwise("unknown")
    return b.sig.select(
        "entity", o.alias("outcome"), F.when(v == "mid", "signup").when(v == "low", F.concat(f, F.lit(" on tip"))).otherwise(f).alias("feature"), F.when(v == "high", None).otherwise(F.col("severity") * 2).alias("confidence")
    )


VALIDATED = f"""SELECT entity, outcome, {r('max(greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(confidence, 0.5::DOUBLE))))', 3)} AS confidence,
  CASE WHEN NOT EXISTS (SELECT 1 FROM ranked k WHERE k.entity = p.entity AND k.outcome = p.outcome) THEN 'not a candidate'
       WHEN count(*) FILTER (EXISTS (SELECT 1 FROM present2 q WHERE q.entity = p.entity AND (contains(q.feature, p.feature) OR contains(p.feature, q.feature)))) = 0 THEN 'no grounded evidence' ELSE 'kept' END AS status
  FROM prop p GROUP BY entity, outcome"""
P_VALID = [C_PROP, C_PRESENT.replace("present AS", "present2 AS")]


@query("j13_validate_proposals", with_([*P_RANKED, *P_VALID], VALIDATED))
def j13(spark, sf):
    b = Behaviour(spark, sf)
    return I.validate_proposals(proposals(b), b.ranked, b.present)


@query("w5_first_per_key", with_([C_SIG], "SELECT entity, feature, value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY severity DESC, feature) AS rn FROM sig) WHERE rn = 1"))
def w5(spark, sf):
    from sigweave.operators.ranking import first_per_key

    s = Behaviour(spark, sf).sig
    return first_per_key(s, ["entity"], [F.col("severity").desc(), F.col("feature")], ["feature", "value"])


@query("pr18_synth_signals", with_([*P_PRESENT], """SELECT p.entity, p.feature, d.v AS class_value, CASE WHEN d.v = p.value THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS p
  FROM present p CROSS JOIN (VALUES ('low'), ('mid'), ('high')) d(v) WHERE p.value <> 'present'"""))
def pr18(spark, sf):
    from sigweave.operators.cases import synth_probs

    b = Behaviour(spark, sf)
    return synth_probs(b.present.filter("value <> 'present'"), kb.VALUES)
