"""Knowledge file to ranked outcomes, on a small knowledge file of our own."""

import json

import pytest

from sigweave.operators import graph
from sigweave.plans import casebook
from sigweave.sources import knowledge

KB = {
    "severity_bands": [{"max": 0.5, "word": "low"}, {"max": 2.0, "word": "high"}],
    "features": {
        "coating": {"label": "Coat", "kind": "graded_value", "absent_value": "non_greasy", "points_to": {"damp": 1.0}},
        "zhi": {"label": "Body", "kind": "categorical", "values": {"dark": {"points_to": {"heat": 0.8, "balanced": 0.9}}, "light": {"points_to": {"cold": 0.7}}}},
    },
    "extra_features": {"swollen": {"label": "Swollen", "points_to": {"damp": 0.5}}},
    "patterns": {
        "damp": {"plain_name": "damp", "associated_symptoms": ["Heavy head"], "recommendations": {"diet": ["Warm meals"]}, "followup_questions": [{"q": "Heavy?", "weight": 0.5}, {"q": "Foggy?"}]},
        "heat": {"plain_name": "heat"},
    },
    "combination_rules": [
        {"id": "r1", "when": {"coat_texture": "greasy", "zhi": ["dark", "regular"]}, "any": {"moisture": "wet", "swollen": "present"}, "boost": {"heat": 0.9, "cold": -1.0}, "note": "n", "cite": "c"},
        {"id": "r2", "enabled": False, "when": {"zhi": "dark"}, "boost": {"cold": 9.0}},
    ],
    "regions": {"_note": "text", "tip": {"organs": "Heart / Lung"}, "root": {"note": "none"}},
    "symptom_patterns": {"cold feet": {"cold": 0.7}},
}
STATS = {"n": 3, "graded": {"coating": {"mean": 0.4, "q": [0.0, 0.2, 0.4, 0.6, 0.8]}}, "categorical": {"zhi": {"dark": 0.25, "light": 0.25, "regular": 0.5}}}
CASES = {
    "cases": [
        {"id": "wet", "note": "", "features": {"coating": "greasy_thick", "zhi": "dark", "moisture": "wet"}, "accept": ["heat"]},
        {"id": "dry", "note": "", "features": {"coating": "greasy_thick", "zhi": "dark"}, "accept": ["damp"]},
        {"id": "plain", "note": "", "features": {"coating": "non_greasy", "zhi": "regular"}, "accept": ["balanced"]},
        {"id": "wrong", "note": "", "features": {"coating": "non_greasy", "zhi": "light"}, "accept": ["heat"]},
    ]
}


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    d = tmp_path_factory.mktemp("kb")
    out = []
    for name, doc in (("kb", KB), ("stats", STATS), ("cases", CASES)):
        p = d / f"{name}.json"
        p.write_text(json.dumps(doc, indent=1))
        out.append(str(p))
    return out


def test_mapping_report(spark, paths):
    r = casebook.mapping_report(spark, *paths).first()
    assert (r["n"], r["n_ok"]) == (4, 3)


def test_case_scores(spark, paths):
    kb = knowledge.read_knowledge(spark, paths[0])
    curves, freq = knowledge.read_population(spark, paths[1])
    spec, _ = knowledge.read_cases(spark, paths[2])
    got = {(x["entity"], x["outcome"]): x["confidence"] for x in casebook.rank_cases(spark, kb, curves, freq, spec).collect()}
    heat = 0.8 * 0.75 + 0.9  # rarity-weighted vote plus the fired rule
    assert got[("wet", "heat")] == pytest.approx(heat / (heat + 1.2), abs=1e-6)
    assert got[("dry", "heat")] == pytest.approx(0.6 / 1.8, abs=1e-6)
    assert got[("dry", "damp")] == pytest.approx(1.0 / 2.2, abs=1e-6)
    assert got[("plain", "balanced")] == 1.0
    # moisture votes for outcomes of its own; the negative boost never creates a score below zero
    assert got[("wet", "damp")] == pytest.approx(1.0 / 2.2, abs=1e-6)


def test_knowledge_tables(spark, paths):
    kb = knowledge.read_knowledge(spark, paths[0])
    assert {(r["rule_id"], r["n_when"], r["n_any"], r["enabled"]) for r in kb.rule_needs.collect()} == {("r1", 2, 2, 1), ("r2", 1, 0, 0)}
    assert {(r["feature"], r["value"]) for r in kb.rule_conditions.filter("rule_id = 'r1' and grp = 'when'").collect()} == {("coat_texture", "greasy"), ("zhi", "dark"), ("zhi", "regular")}
    assert [tuple(r) for r in kb.regions.collect()] == [("tip", "Heart / Lung")]


def test_graph_from_knowledge(spark, paths):
    kb = knowledge.read_knowledge(spark, paths[0])
    e = {(r["src"], r["rel"], r["dst"]): r["weight"] for r in graph.seed_graph(kb.outcomes, kb.values, kb.regions, kb.reported).collect()}
    assert e[("pattern:damp", "has_symptom", "symptom:heavy-head")] is None
    assert e[("symptom:heavy-head", "evidence_for", "pattern:damp")] == 0.3
    assert e[("question:foggy", "evidence_for", "pattern:damp")] == 0.4
    assert e[("value:swollen=present", "points_to", "pattern:damp")] == 0.5
    assert e[("value:zhi=light", "points_to", "pattern:cold")] == 0.7
    assert e[("region:tip", "maps_to", "organ:lung")] is None
    assert e[("symptom:cold-feet", "evidence_for", "pattern:cold")] == 0.7
    assert len(e) == 19
