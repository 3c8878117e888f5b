"""Knowledge files: one nested JSON document to the normalised tables the operators join with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = "struct<tcm_term:string,plain_gloss:string,points_to:map<string,double>>"
_FEATURE = f"struct<label:string,kind:string,absent_value:string,tcm_term:string,present_tcm:string,present_plain:string,points_to:map<string,double>,values:map<string,{_VALUE}>>"
_PATTERN = (
    "struct<tcm_name:string,plain_name:string,explanation:string,associated_symptoms:array<string>,modern_correlation:string,"
    "recommendations:map<string,array<string>>,followup_questions:array<struct<q:string,weight:double>>>"
)
_RULE = "struct<id:string,when:map<string,string>,any:map<string,string>,boost:map<string,double>,enabled:boolean,cite:string,note:string>"
KNOWLEDGE = (
    f"severity_bands array<struct<max:double,word:string>>, features map<string,{_FEATURE}>, extra_features map<string,{_FEATURE}>, "
    f"patterns map<string,{_PATTERN}>, combination_rules array<{_RULE}>, regions map<string,string>, symptom_patterns map<string,map<string,double>>, sources array<string>"
)
STATS = "graded map<string,struct<mean:double,q:array<double>>>, categorical map<string,map<string,double>>"


@dataclass
class Knowledge:
    features: DataFrame  # feature, kind, default_value, label
    votes: DataFrame  # feature, value, outcome, weight
    rule_needs: DataFrame  # rule_id, rule_ord, n_when, n_any, enabled
    rule_conditions: DataFrame  # rule_id, grp, feature, value
    rule_boosts: DataFrame  # rule_id, outcome, delta
    rule_notes: DataFrame  # rule_id, note, cite
    outcomes: DataFrame  # id, symptoms, recs, questions
    values: DataFrame  # id, kind, points_to, values: nested rows for the graph builder
    regions: DataFrame  # zone, organs
    reported: DataFrame  # symptom, outcome, weight
    bands: DataFrame  # pos, max, word


def _choices(c: Column) -> Column:
    """A rule value is one word or a JSON list of words."""
    return F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def read_knowledge(spark: SparkSession, path: str) -> Knowledge:
    """Read the nested document with a literal schema; every table below is a local explode of it."""
    d = spark.read.schema(KNOWLEDGE).option("multiLine", True).json(path)
    core = d.select(F.explode("features").alias("feature", "f"))
    extra = d.select(F.explode("extra_features").alias("feature", "f"))
    kind = F.when(F.col("f.kind") == "graded_value", "graded").otherwise("categorical")
    features = core.select("feature", kind.alias("kind"), F.col("f.absent_value").alias("default_value"), F.col("f.label").alias("label")).unionByName(
        extra.select("feature", F.lit("extra").alias("kind"), F.lit("absent").alias("default_value"), F.col("f.label").alias("label"))
    )
    flat = lambda x: x.select("feature", F.lit("present").alias("value"), F.explode("f.points_to").alias("outcome", "weight"))
    by_value = core.select("feature", F.explode("f.values").alias("value", "v")).select("feature", "value", F.explode("v.points_to").alias("outcome", "weight"))
    votes = flat(core.filter("f.kind = 'graded_value'")).unionByName(flat(extra)).unionByName(by_value)

    rules = d.select(F.posexplode("combination_rules").alias("rule_ord", "r"))
    n = lambda m: F.coalesce(F.size(F.map_keys(m)), F.lit(0))
    size = lambda m: F.when(F.col(m).isNull(), F.lit(0)).otherwise(n(F.col(m))).cast("int")
    needs = rules.select(
        F.col("r.id").alias("rule_id"), "rule_ord", size("r.when").alias("n_when"), size("r.any").alias("n_any"), F.coalesce("r.enabled", F.lit(True)).cast("int").alias("enabled")
    )
    side = lambda g: rules.select(F.col("r.id").alias("rule_id"), F.lit(g).alias("grp"), F.explode(F.col(f"r.{g}")).alias("feature", "v")).select("rule_id", "grp", "feature", F.explode(_choices(F.col("v"))).alias("value"))
    outcomes = d.select(F.explode("patterns").alias("id", "p")).select(
        "id", "p.plain_name", F.coalesce("p.associated_symptoms", F.array().cast("array<string>")).alias("symptoms"),
        F.coalesce("p.recommendations", F.create_map().cast("map<string,array<string>>")).alias("recs"),
        F.coalesce("p.followup_questions", F.array().cast("array<struct<q:string,weight:double>>")).alias("questions"),
    )
    none, no_values = F.create_map().cast("map<string,double>"), F.create_map().cast("map<string,map<string,double>>")
    vals = F.transform_values("f.values", lambda k, v: F.coalesce(v["points_to"], none))
    values = core.select(F.col("feature").alias("id"), "f.kind", F.coalesce("f.points_to", none).alias("points_to"), F.coalesce(vals, no_values).alias("values")).unionByName(
        extra.select(F.col("feature").alias("id"), F.lit("extra").alias("kind"), F.coalesce("f.points_to", none).alias("points_to"), no_values.alias("values"))
    )
    regions = d.select(F.explode("regions").alias("zone", "j")).select("zone", F.get_json_object("j", "$.organs").alias("organs")).filter("organs is not null and not startswith(zone, '_')")
    return Knowledge(
        features=features,
        votes=votes,
        rule_needs=needs,
        rule_conditions=side("when").unionByName(side("any")),
        rule_boosts=rules.select(F.col("r.id").alias("rule_id"), F.explode("r.boost").alias("outcome", "delta")),
        rule_notes=rules.select(F.col("r.id").alias("rule_id"), F.coalesce("r.note", F.lit("")).alias("note"), F.coalesce("r.cite", F.lit("")).alias("cite")),
        outcomes=outcomes,
        values=values,
        regions=regions,
        reported=d.select(F.explode("symptom_patterns").alias("symptom", "m")).select("symptom", F.explode("m").alias("outcome", "weight")),
        bands=d.select(F.posexplode("severity_bands").alias("pos", "b")).select("pos", "b.max", "b.word"),
    )


def read_population(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(curves(feature, mean, q), freq(feature, value, freq)) from a population reference file."""
    d = spark.read.schema(STATS).option("multiLine", True).json(path)
    curves = d.select(F.explode("graded").alias("feature", "s")).select("feature", "s.mean", "s.q")
    freq = d.select(F.explode("categorical").alias("feature", "m")).select("feature", F.explode("m").alias("value", "freq"))
    return curves, freq


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Golden cases: (cases(entity, feature, value), accept(entity, outcome))."""
    shape = "cases array<struct<id:string,note:string,features:map<string,string>,accept:array<string>>>"
    d = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("cases").alias("c"))
    return (
        d.select(F.col("c.id").alias("entity"), F.explode("c.features").alias("feature", "value")),
        d.select(F.col("c.id").alias("entity"), F.explode("c.accept").alias("outcome")),
    )


# How entries of a knowledge document read as corpus chunks.
WHEN_PRESENT, PLAIN, LEADS_TO = " — when present: ", ". In plain terms: ", " Traditionally associated with: "
NOTICED, VIEW, NOTES, REASONING, REFLECTS = " Often noticed: ", " Modern view: ", " Wellness notes: ", "Combination reasoning: ", " reflects "


def knowledge_chunks(docs: DataFrame, keep: list[str], balanced: str = "balanced", zone_prefix: str = "Tongue ", outcome_source: str = "", zone_source: str = "") -> DataFrame:
    """(*keep, id, text, source): corpus chunks of nested knowledge documents (the columns of `KNOWLEDGE`).

    One chunk per graded feature, value with a gloss or term, extra feature, outcome (but the neutral one), rule with a
    note and zone with organs. Every chunk is made from one entry, so this is a chain of local explodes.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    some = lambda c: text(c) != ""
    first_two = F.array_join(F.slice(F.coalesce("sources", F.array().cast("array<string>")), 1, 2), "; ")
    d = docs.withColumn("_src", first_two)
    of = lambda col: d.select(*keep, "_src", F.explode(col).alias("k", "f")).withColumn("label", F.coalesce("f.label", "k"))
    core, extra = of("features"), of("extra_features")
    out = lambda rows, i, t, src: rows.select(*keep, i.alias("id"), t.alias("text"), src.alias("source"))
    k, label, src = F.col("k"), F.col("label"), F.col("_src")
    graded = core.filter((F.col("f.kind") == "graded_value") & some(F.col("f.present_tcm")))
    a = out(graded, F.concat(F.lit("feature:"), k), F.concat(label, F.lit(WHEN_PRESENT), text(F.col("f.present_tcm")), F.lit(PLAIN), text(F.col("f.present_plain")), F.lit(".")), src)
    v = core.select(*keep, "_src", "k", "label", F.explode("f.values").alias("v", "x")).filter(some(F.col("x.plain_gloss")) | some(F.col("x.tcm_term")))
    to = F.array_join(F.map_keys(F.coalesce("x.points_to", F.create_map().cast("map<string,double>"))), ", ")
    tail = F.when(to != "", F.concat(F.lit(LEADS_TO), to, F.lit("."))).otherwise("")
    body = F.concat(label, F.lit(" '"), F.col("v"), F.lit("' ("), text(F.col("x.tcm_term")), F.lit("): "), text(F.col("x.plain_gloss")), tail)
    b = out(v, F.concat(F.lit("feature:"), k, F.lit("="), F.col("v")), body, src)
    e = extra.filter(some(F.col("f.present_tcm")) | some(F.col("f.present_plain")))
    c = out(e, F.concat(F.lit("extra:"), k), F.concat(label, F.lit(": "), text(F.col("f.present_tcm")), F.lit(". "), text(F.col("f.present_plain"))), src)
    p = d.select(*keep, F.explode("patterns").alias("k", "p")).filter(k != balanced)
    listed = lambda c, sep: F.array_join(c, sep)
    of_kind = lambda n: F.coalesce(F.try_element_at("p.recommendations", F.lit(n)), F.array().cast("array<string>"))
    advice = F.slice(F.concat(of_kind("diet"), of_kind("lifestyle")), 1, 4)
    symptoms = listed(F.coalesce("p.associated_symptoms", F.array().cast("array<string>")), ", ")
    body = F.concat(
        F.coalesce("p.tcm_name", "k"), F.lit(" ("), text(F.col("p.plain_name")), F.lit("): "), text(F.col("p.explanation")),
        F.when(symptoms != "", F.concat(F.lit(NOTICED), symptoms, F.lit("."))).otherwise(""),
        F.when(some(F.col("p.modern_correlation")), F.concat(F.lit(VIEW), F.col("p.modern_correlation"), F.lit("."))).otherwise(""),
        F.when(F.size(advice) > 0, F.concat(F.lit(NOTES), listed(advice, "; "), F.lit("."))).otherwise(""),
    )
    g = out(p, F.concat(F.lit("pattern:"), k), body, F.lit(outcome_source))
    r = d.select(*keep, F.explode("combination_rules").alias("r")).filter(some(F.col("r.note")))
    h = out(r, F.concat(F.lit("rule:"), F.col("r.id")), F.concat(F.lit(REASONING), F.col("r.note")), text(F.col("r.cite")))
    z = d.select(*keep, F.explode("regions").alias("k", "z")).select(*keep, "k", F.from_json("z", "organs string, note string").alias("z")).filter(some(F.col("z.organs")))
    i = out(z, F.concat(F.lit("zone:"), k), F.concat(F.lit(zone_prefix), k, F.lit(REFLECTS), F.col("z.organs"), F.lit(": "), text(F.col("z.note"))), F.lit(zone_source))
    return a.unionByName(b).unionByName(c).unionByName(g).unionByName(h).unionByName(i)
