"""Check a knowledge file against a golden case table, end to end.

    python -m sigweave.plans.casebook KNOWLEDGE.json POPULATION.json CASES.json
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.dims import Dim
from sigweave.operators import cases as C
from sigweave.operators import inference as I
from sigweave.operators import signals as G
from sigweave.sources import knowledge as K

# The label domains in grade order, and the severity each grade is synthesised with.
DOMAINS = {
    "coating": ["non_greasy", "greasy", "greasy_thick"],
    "tai": ["white", "light_yellow", "yellow"],
    "zhi": ["light", "regular", "dark"],
    "fissure": ["none", "light", "severe"],
    "tooth_mk": ["none", "light", "severe"],
}
SEVERITIES = {
    "coating": {"non_greasy": 0.15, "greasy": 0.7, "greasy_thick": 0.92},
    "fissure": {"none": 0.0, "light": 0.5, "severe": 0.92},
    "tooth_mk": {"none": 0.0, "light": 0.5, "severe": 0.92},
}
# Multi-label signs with their measured reliability as vote factor (0.35 if unlisted),
# the sign that is never voted on, and the zone signs (stated words, reported word, severity).
RELIABILITY = {
    "red_dots": 0.68,
    "red_tongue": 0.61,
    "thin": 0.58,
    "peeled_coating": 0.55,
    "slippery_coating": 0.33,
    "swollen": 0.19,
    "purple_body": 0.17,
    "black_coating": 0.35,
}
UNLISTED = 0.35
REMOVED = ["black_coating"]
ZONES = {
    "red_tip": (["present", "strong"], "present", 0.85),
    "red_sides": (["present"], "present", 0.7),
    "moisture": (["wet"], "wet", 0.7),
}
# Votes of the zone signs, the kinds of signs without a domain, the axes of the coating grades.
ZONE_VOTES = Dim(
    "zone_votes",
    [("feature", "string"), ("value", "string"), ("outcome", "string"), ("weight", "double")],
    [
        ("red_tip", "present", "yin_deficiency", 0.4),
        ("red_tip", "present", "damp_heat", 0.3),
        ("red_sides", "present", "qi_stagnation", 0.45),
        ("red_sides", "present", "damp_heat", 0.2),
        ("moisture", "present", "yang_deficiency", 0.4),
        ("moisture", "present", "phlegm_dampness", 0.3),
    ],
)
OTHER_SIGNS = Dim(
    "other_signs",
    [("feature", "string"), ("kind", "string")],
    [("red_tip", "zone"), ("red_sides", "zone"), ("moisture", "zone"), ("coat_thickness", "axis"), ("coat_texture", "axis")],
)
AXES = (("coat_thickness", "thick", "thin"), ("coat_texture", "greasy", "smooth"))


def rank_cases(spark: SparkSession, kb: K.Knowledge, curves: DataFrame, freq: DataFrame, cases: DataFrame) -> DataFrame:
    """Ranked outcomes of every case: synthesised signals, votes, rules, confidences."""
    sig = C.synth_signals(cases, DOMAINS, SEVERITIES, list(RELIABILITY), ZONES)
    sig = sig.unionByName(C.axis_signals(sig, "coating", "greasy", "greasy_thick", AXES))
    factor = F.lit(UNLISTED)
    for f, w in RELIABILITY.items():
        factor = F.when(F.col("feature") == f, F.lit(w)).otherwise(factor)
    signs = kb.features.filter(~F.col("feature").isin(REMOVED)).select("feature", "kind").unionByName(OTHER_SIGNS.df(spark))
    read = G.readings(sig, signs.withColumn("reliability", factor), curves, freq)
    # The side sign votes but is not offered to the rules.
    present = I.present_features(read, [*REMOVED, "red_sides"], {"moisture": "wet"})
    fired = I.fire_rules(present, kb.rule_conditions, kb.rule_needs)
    votes = I.vote_rows(read, kb.votes.unionByName(ZONE_VOTES.df(spark))).filter(F.col("outcome") != I.BALANCED)
    scores = I.apply_rules(votes.select("entity", "outcome", F.col("weight").alias("score")), fired, kb.rule_boosts)
    return I.rank_outcomes(scores, sig.select("entity").distinct())


def mapping_report(spark: SparkSession, knowledge: str, population: str, cases: str) -> DataFrame:
    curves, freq = K.read_population(spark, population)
    spec, accept = K.read_cases(spark, cases)
    return C.mapping_accuracy(rank_cases(spark, K.read_knowledge(spark, knowledge), curves, freq, spec), accept)


if __name__ == "__main__":
    from sigweave.session import build_session

    mapping_report(build_session("casebook"), *sys.argv[1:4]).show()
