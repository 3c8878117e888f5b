"""Golden literals for the operators whose edge cases matter."""

import math

import pytest
from pyspark.sql import functions as F

from sigweave.functions import scores as S
from sigweave.operators import cases, corpus, evaluate, graph, inference, labels, matching, retrieval, sampling, signals


def one(df, col):
    return df.collect()[0][col]


def test_ordered_fold_clamps_after_each_rule(spark):
    scores = spark.createDataFrame([(1, "a", 0.2)], "entity int, outcome string, score double")
    fired = spark.createDataFrame([(1, "r1", 1), (1, "r2", 2)], "entity int, rule_id string, rule_ord int")
    boosts = spark.createDataFrame([("r1", "a", -0.5), ("r2", "a", 0.4), ("r2", "b", -1.0)], "rule_id string, outcome string, delta double")
    got = {r["outcome"]: r["score"] for r in inference.apply_rules(scores, fired, boosts).collect()}
    assert got == {"a": pytest.approx(0.4), "b": 0.0}


@pytest.mark.parametrize(
    "sev,want",
    [(0.11, 0.0), (0.12, None), (0.25, 0.125), (0.5, 0.5), (0.95, 1.0)],
)
def test_percentile_rank(spark, sev, want):
    q = [0.2, 0.3, 0.5, 0.5, 0.9]  # four steps, one flat
    df = spark.createDataFrame([(sev, q)], "s double, q array<double>")
    got = one(df.select(S.curve_rank(F.col("s"), F.col("q")).alias("r")), "r")
    if want is None:
        assert got == 0.0  # under the first point: clamped, not negative
    else:
        assert got == pytest.approx(want)


def test_percentile_rank_flat_step_and_fallback(spark):
    df = spark.createDataFrame([(0.5, [0.5, 0.5, 0.5]), (0.65, None), (0.65, [0.0, 0.1, 0.15]), (1.0, None)], "s double, q array<double>")
    got = [r["r"] for r in df.select(S.curve_rank(F.col("s"), F.col("q")).alias("r")).collect()]
    assert got == [0.0, 0.5, 0.5, 1.0]


def test_rank_outcomes_balanced_lead(spark):
    scores = spark.createDataFrame([(1, "a", 0.3), (2, "a", 2.0), (2, "b", 2.0)], "entity int, outcome string, score double")
    ents = spark.createDataFrame([(1,), (2,), (3,)], "entity int")
    got = {(r["entity"], r["rank"]): (r["outcome"], r["confidence"]) for r in inference.rank_outcomes(scores, ents).collect()}
    assert got[(1, 1)] == ("balanced", pytest.approx(1 - 0.3 / 0.55, abs=1e-6))
    assert got[(1, 2)] == ("a", pytest.approx(0.2, abs=1e-6))
    assert got[(2, 1)][0] == "a" and got[(2, 2)][0] == "b"
    assert got[(3, 1)] == ("balanced", 1.0)


def test_rule_needs_when_even_if_any_matches(spark):
    present = spark.createDataFrame([(1, "x", "1"), (2, "x", "1"), (2, "y", "2")], "entity int, feature string, value string")
    conds = spark.createDataFrame([("r", "when", "y", "2"), ("r", "any", "x", "1")], "rule_id string, grp string, feature string, value string")
    needs = spark.createDataFrame([("r", 1, 1, 1, 1)], "rule_id string, rule_ord int, n_when int, n_any int, enabled int")
    assert [r["entity"] for r in inference.fire_rules(present, conds, needs).collect()] == [2]


def test_ensemble_caps_added_and_keeps_prior(spark):
    prior = spark.createDataFrame([(1, "a", 0.6, 1), (1, "b", 0.5, 2)], "entity int, outcome string, confidence double, rank int")
    ev = spark.createDataFrame([(1, "c", 1.0, 4), (1, "a", 0.1, 2)], "entity int, outcome string, confidence double, n_cites bigint")
    got = {r["outcome"]: (r["confidence"], r["origin"]) for r in inference.ensemble(prior, ev, 0.2).collect()}
    assert got["a"] == (pytest.approx(0.5), "ensemble")
    assert got["b"] == (pytest.approx(0.5), "prior")
    assert got["c"] == (pytest.approx(0.2), "evidence-added")


def test_ensemble_respects_balanced_lead(spark):
    prior = spark.createDataFrame([(1, "balanced", 0.6, 1), (1, "b", 0.2, 2)], "entity int, outcome string, confidence double, rank int")
    ev = spark.createDataFrame([(1, "b", 1.0, 4)], "entity int, outcome string, confidence double, n_cites bigint")
    got = inference.ensemble(prior, ev).collect()
    assert {r["origin"] for r in got} == {"passthrough"} and len(got) == 2


@pytest.mark.parametrize("c", [0.0, 1.0, 0.4])
def test_logodds_is_finite(spark, c):
    df = spark.createDataFrame([(c,)], "c double")
    got = one(df.select(S.logodds_update(F.col("c"), F.lit(0.5)).alias("v")), "v")
    p = min(max(c, 1e-3), 1 - 1e-3)
    assert got == pytest.approx(1 / (1 + math.exp(-(math.log(p / (1 - p)) + 0.7))))


def test_evidence_corroboration_is_capped(spark):
    rows = [("value:a=1", "points_to", "pattern:x", 0.5, "s", "1")] + [("value:b=1", "points_to", "pattern:x", 0.5, "s", str(i)) for i in range(1000)]
    e = spark.createDataFrame(rows, "src string, rel string, dst string, weight double, source string, snippet string")
    g = {r["src"]: r["contribution"] for r in graph.evidence_groups(e).collect()}
    idf = 1 + 0.55 * (math.log(2) - math.log(1 + 1 / 3)) / math.log(1 + 1 / 3)
    idf = min(1.55, max(0.65, idf))
    assert g["value:a=1"] == pytest.approx(0.5 * idf)
    assert g["value:b=1"] == pytest.approx(1.3 * idf)


def test_rrf_with_one_list_keeps_its_order(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2)], "q int, d int, rank int")
    got = retrieval.rrf([a, a.limit(0)], "q", "d").orderBy("rank").collect()
    assert [r["d"] for r in got] == [10, 11, 12]


def test_average_precision_without_positives_is_null(spark):
    s = spark.createDataFrame([("f", 1, 0.9, 0), ("f", 2, 0.1, 0), ("g", 1, 0.9, 1), ("g", 2, 0.5, 0), ("g", 3, 0.1, 1)], "feature string, id int, score double, g int")
    got = {r["feature"]: r["ap"] for r in evaluate.average_precision(s, "id").collect()}
    assert got["f"] is None and got["g"] == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)


def test_jaccard_of_two_empty_lists_is_one(spark):
    e = spark.createDataFrame([(1,)], "entity int")
    none = spark.createDataFrame([], "entity int, outcome string, rank int")
    r = inference.shadow_rows(none, none, e).collect()[0]
    assert (r["jaccard"], r["top1"], r["abstain"]) == (1.0, False, True)


def test_absent_readings_and_aliases_resolve(spark):
    present = spark.createDataFrame([(1, "tex", "rough"), (1, "crack", "none"), (1, "body", "pale"), (1, "tone", "odd"), (1, "tex2", "smooth")], "entity int, feature string, value string")
    nodes = spark.createDataFrame([("value:coat=present",), ("value:body=light",), ("feature:tone",)], "id string")
    got = graph.resolve_entries(present, nodes, {"tex": "coat"}, {("body", "pale"): "light"}, binary=["coat"], positive={"tex2": ["rough"]})
    assert {r["feature"]: r["node"] for r in got.collect()} == {"tex": "value:coat=present", "body": "value:body=light", "tone": "feature:tone"}


def test_resolve_target_weights(spark):
    d = spark.createDataFrame([("mid", "high"), ("mid", None), (None, None), ("zzz", "yyy")], "a string, m string")
    got = [(r["target"], r["weight"]) for r in labels.resolve_target(d, "a", "m", ["low", "mid", "high"]).collect()]
    assert got == [(2, 2.0), (1, 1.0), (0, 0.0), (0, 0.0)]


def test_derive_axes(spark):
    d = spark.createDataFrame([(1, 0.2, 0.5, 0.3)], "entity int, p1 double, p2 double, p3 double")
    got = {r["axis"]: (r["value"], round(r["confidence"], 6), round(r["severity"], 6)) for r in signals.derive_axes(d).collect()}
    assert got == {"thickness": ("thin", 0.7, 0.3), "texture": ("greasy", 0.8, 0.8)}


def test_mapping_accuracy_skips_balanced_filler(spark):
    r = spark.createDataFrame([(1, "balanced", 1), (1, "a", 2), (2, "balanced", 1), (2, "a", 2)], "entity int, outcome string, rank int")
    acc = spark.createDataFrame([(1, "a"), (2, "balanced")], "entity int, outcome string")
    assert one(cases.mapping_accuracy(r, acc), "n_ok") == 2


def test_questions_cover_both_candidates(spark):
    ranked = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.5, 2), (2, "c", 0.4, 1)], "entity int, outcome string, confidence double, rank int")
    probes = spark.createDataFrame([("a", "q1", 0.9), ("a", "q2", 0.8), ("a", "q3", 0.7), ("b", "q1", 0.6), ("b", "q4", 0.1)], "outcome string, question string, weight double")
    spare = spark.createDataFrame([("c", 1, "own")], "outcome string, pos int, question string")
    got = graph.select_questions(ranked, probes, spare).orderBy("entity", "pos").collect()
    assert [(r["entity"], r["question"], r["target"]) for r in got] == [(1, "q1", "a"), (1, "q4", "b"), (1, "q2", "a"), (2, "own", "c")]


def test_greedy_picks_do_not_reuse_rows(spark):
    c = spark.createDataFrame([(0, 1, 9.0), (0, 2, 8.0), (1, 1, 9.0), (1, 3, 1.0), (2, 1, 9.0), (2, 3, 5.0)], "target int, id int, s double")
    got = {r["target"]: r["id"] for r in sampling.greedy_picks(c, "id", [F.desc("s")], 3).collect()}
    assert got == {0: "1", 1: "3"}  # target 2 has nothing left


def test_numbered_headings(spark):
    text = "1.1 Scope . . . 4\n1.2 Old title\nfront\n1.2 Real title\nbody one\n1.2.1 Sub part\nbody two\n2.1 Ends with page 12\n3.1 9bad\n"
    d = spark.createDataFrame([(1, text)], "doc int, text string")
    got = {r["num"]: r for r in corpus.parse_numbered(d, "doc", "text").collect()}
    assert set(got) == {"1.2", "1.2.1"}
    s = got["1.2"]
    assert text[s["body_start"] : s["body_end"]] == "body one\n"
    assert (got["1.2.1"]["parent"], got["1.2.1"]["chapter"], got["1.2.1"]["level"]) == ("1.2", "1", 3)
    assert got["1.2.1"]["body_end"] == len(text)


def test_verbatim_join_matches_brute_force(spark):
    texts = [(1, "The Quick  brown\nfox jumps over the lazy dog"), (2, "xconcat sat on the mats"), (3, "cat"), (4, ""), (5, "a b c d e f g h i j")]
    items = [(1, "quick brown fox jumps over the lazy"), (2, "cat sat on the mat"), (3, "cat"), (4, "on the"), (5, "c d e f g h"), (6, "zzz"), (7, "at s"), (8, "b c d"), (9, " ")]
    t = spark.createDataFrame(texts, "tid int, t string")
    i = spark.createDataFrame(items, "iid int, s string")
    fold = lambda s: " ".join(s.lower().split())
    want = {(a, b) for a, x in texts for b, y in items if fold(y) and fold(y) in fold(x)}
    got = {(r["tid"], r["iid"]) for r in matching.contains_join(t, "tid", "t", i, "iid", "s").collect()}
    assert got == want and (2, 2) in want and (2, 7) in want


def test_cosine_topk_matches_numpy(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8))
    q = rng.normal(size=(5, 8))
    dv = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "i bigint, v array<double>").repartition(7)
    dq = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "i bigint, v array<double>")
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    want = {(a, int(b)): k for a in range(5) for k, b in enumerate(np.argsort(-s[a])[:6])}
    for sizes in ((1024, 8192), (2, 30)):  # one block, and a grid of blocks
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", sizes[0])
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", sizes[1])
        got = {(r["query_id"], r["vector_id"]): r["rank"] for r in retrieval.cosine_topk(dv, "i", "v", dq, "i", "v", 6).collect()}
        assert got == want


def test_lexical_text_prefixes_id_words(spark):
    d = spark.createDataFrame([("pattern:damp_heat", "body")], "i string, t string")
    assert one(d.select(retrieval.lexical_text(F.col("i"), F.col("t")).alias("v")), "v") == "damp heat. body"


def test_tfidf_matches_direct_formula(spark):
    import collections

    docs = [(1, "red fox red dog"), (2, "blue fox"), (3, "dog dog dog cat"), (4, "nothing here")]
    qs = [(1, "red fox"), (2, "dog cat unknownword")]

    def terms(t):
        w = [x for x in t.split() if x != "the"]
        return collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    tf = {i: terms(t) for i, t in docs}
    df = collections.Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}
    vec = lambda c: {t: n * idf[t] for t, n in c.items() if t in idf}
    unit = lambda v: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()}
    want = {}
    for qi, qt in qs:
        q = unit(vec(terms(qt)))
        for di, c in tf.items():
            s = sum(x * unit(vec(c)).get(t, 0.0) for t, x in q.items())
            if s > 0:
                want[(qi, di)] = s
    d = spark.createDataFrame(docs, "d int, t string")
    q = spark.createDataFrame(qs, "q int, t string")
    got = {(r["q"], r["d"]): r["score"] for r in retrieval.tfidf_topk(d, "d", "t", q, "q", "t", ["the"]).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-8)
