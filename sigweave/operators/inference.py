"""Rule inference: votes, co-occurrence rules, ranking, explanation, evidence blending.

Inputs are readings (see `signals.readings`) partitioned by entity and literal
knowledge tables. Everything grouped per entity is bounded by the knowledge
tables (features, outcomes, rules), so per-entity windows and lists stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigweave.functions import scores as S
from sigweave.session import cut

BALANCED = "balanced"


# ---- what is present --------------------------------------------------------------------


def present_features(read: DataFrame, removed: Sequence[str] = (), words: dict[str, str] | None = None) -> DataFrame:
    """Flat (entity, feature, value) of raw detections for the rules.

    Core signs (graded, categorical, display axes) always contribute their value.
    Extra and zone signs contribute `present` (or their word in `words`) only when
    detected (`severity >= 0.5`), and never if removed.
    """
    core = F.col("kind").isin("graded", "categorical", "axis")
    on = (F.col("severity") >= 0.5) & ~F.col("feature").isin(list(removed) or [""])
    word = F.lit("present")
    for f, w in (words or {}).items():
        word = F.when(F.col("feature") == f, F.lit(w)).otherwise(word)
    return read.filter(core | on).select("entity", "feature", F.when(core, F.col("value")).otherwise(word).alias("value"))


# ---- votes -------------------------------------------------------------------------------


def vote_rows(read: DataFrame, votes: DataFrame) -> DataFrame:
    """(entity, feature, outcome, weight): distinctiveness-weighted votes.

    Graded signs vote `w * rel` when surfaced, categorical `w * rarity`, extras
    `w * rel * reliability`, zone signs `w * severity`.
    """
    factor = F.when(F.col("kind") == "extra", F.col("rel") * F.col("reliability")).otherwise(F.col("rel"))
    key = F.when(F.col("kind") == "categorical", F.col("value")).otherwise(F.lit("present"))
    r = read.filter("mentioned").select("entity", "feature", key.alias("value"), factor.alias("factor"))
    return r.join(votes, ["feature", "value"]).select(
        "entity", "feature", "value", "outcome", (F.col("weight") * F.col("factor")).alias("weight")
    )


def tally(votes: DataFrame, drop: str = BALANCED) -> DataFrame:
    """Vote sum per (entity, outcome), without the balanced filler."""
    return votes.filter(F.col("outcome") != drop).groupBy("entity", "outcome").agg(F.sum("weight").alias("score"))


# ---- rules -------------------------------------------------------------------------------


def fire_rules(present: DataFrame, conditions: DataFrame, needs: DataFrame) -> DataFrame:
    """(entity, rule_id, rule_ord): rules whose `when` all match and, if any `any`
    conditions exist, at least one of those matches; enabled rules only.

    `conditions(rule_id, grp, feature, value)` may list several values per
    feature; `needs(rule_id, rule_ord, n_when, n_any, enabled)`. An entity has
    one value per feature, so counting matched `when` rows counts features.
    """
    hit = present.join(conditions, ["feature", "value"]).groupBy("entity", "rule_id").agg(
        F.count(F.when(F.col("grp") == "when", 1)).alias("hw"), F.count(F.when(F.col("grp") == "any", 1)).alias("ha")
    )
    return (
        hit.join(needs.filter("enabled = 1"), "rule_id")
        .filter((F.col("hw") == F.col("n_when")) & ((F.col("n_any") == 0) | (F.col("ha") > 0)))
        .select("entity", "rule_id", "rule_ord")
    )


def apply_rules(scores: DataFrame, fired: DataFrame, boosts: DataFrame) -> DataFrame:
    """Fold the fired deltas into the scores in rule order, clamping at 0 after EVERY rule.

    Outcomes without votes start at 0. The list per (entity, outcome) is bounded
    by the number of rules.
    """
    none = F.lit(None).cast("struct<rule_ord:int,delta:double>")
    rows = scores.select("entity", "outcome", "score", none.alias("d")).unionByName(
        fired.join(boosts, "rule_id").select(
            "entity", "outcome", F.lit(None).cast("double").alias("score"), F.struct("rule_ord", "delta").alias("d")
        )
    )
    # Placed by entity, the (entity, outcome) groups and the ranking after them share one exchange.
    per = rows.repartition("entity").groupBy("entity", "outcome").agg(
        F.coalesce(F.sum("score"), F.lit(0.0)).alias("base"), F.array_sort(F.collect_list("d")).alias("ds")
    )
    folded = F.aggregate("ds", F.col("base"), lambda acc, d: F.greatest(acc + d["delta"], F.lit(0.0)))
    return per.select("entity", "outcome", folded.alias("score"))


# ---- ranking -----------------------------------------------------------------------------


def rank_outcomes(scores: DataFrame, entities: DataFrame, k: int = 3) -> DataFrame:
    """Top-k outcomes per entity with saturating confidence.

    If the best score is under 0.55 the balanced outcome leads (rank 1) with
    `1 - best / 0.55`; entities without any vote get balanced at 1. Ties break
    on the outcome name.
    """
    spine = entities.select("entity", F.lit(BALANCED).alias("outcome"), F.lit(None).cast("double").alias("score"))
    rows = scores.filter(F.col("outcome") != BALANCED).select("entity", "outcome", S.rnd(F.col("score"), 9).alias("score"))
    w = W.partitionBy("entity")
    r = (
        rows.unionByName(spine)
        .withColumn("rk", F.row_number().over(w.orderBy(F.col("score").desc_nulls_last(), "outcome")))
        .withColumn("best", F.coalesce(F.max("score").over(w), F.lit(0.0)))
    )
    weak, filler = F.col("best") < S.BALANCED_CUT, F.col("score").isNull()
    conf = F.when(filler, F.lit(1.0) - F.col("best") / S.BALANCED_CUT).otherwise(S.saturate(F.col("score")))
    rank = F.when(filler, F.lit(1)).otherwise(F.col("rk") + F.when(weak, 1).otherwise(0))
    return r.filter(F.when(filler, weak).otherwise(F.col("rk") <= k)).select(
        "entity", "outcome", S.rnd(conf, 6).alias("confidence"), rank.alias("rank")
    )


def lead_of(ranked: DataFrame) -> DataFrame:
    return ranked.filter("rank = 1").select("entity", F.col("outcome").alias("lead"), F.col("confidence").alias("lead_confidence"))


# ---- wording -----------------------------------------------------------------------------


def findings(read: DataFrame, phrases: DataFrame, caveat: tuple[str, str, str, str, str]) -> DataFrame:
    """Notable signs in display order: tier ascending, `rel * trust` descending.

    `phrases(feature, value, phrase)`: an exact value wins over the `*` row.
    `caveat` = (sign, other feature, other value, its value, wording): when the
    other sign co-occurs the first sign is worded with doubt.
    """
    from sigweave.operators.signals import notable

    sign, f2, v2, _, doubt = caveat
    both = F.max(F.when((F.col("feature") == f2) & (F.col("value") == v2), 1).otherwise(0)).over(W.partitionBy("entity"))
    exact = phrases.filter("value <> '*'").withColumnRenamed("phrase", "_exact")
    any_value = phrases.filter("value = '*'").select("feature", F.col("phrase").alias("_any"))
    doubted = (F.col("feature") == sign) & (F.col("_both") == 1)
    f = (
        notable(read.withColumn("_both", both))
        .join(exact, ["feature", "value"], "left")
        .join(any_value, "feature", "left")
        .withColumn("phrase", F.when(doubted, F.lit(doubt)).otherwise(F.coalesce("_exact", "_any")))
        .filter(F.col("phrase").isNotNull())
        .withColumn("doubted", doubted)
        .withColumn("prominence", S.rnd(F.col("rel") * F.col("trust"), 6))
    )
    order = W.partitionBy("entity").orderBy("tier", F.desc("prominence"), "feature")
    return f.withColumn("pos", F.row_number().over(order)).select(
        "entity", "pos", "feature", "value", "phrase", "tier", "prominence", "doubted", "rel", "label"
    )


def list_phrase(arr: Column, n: int = 4) -> Column:
    """'a, b and c' over the first n items."""
    head = F.slice(arr, 1, n)
    size = F.size(head)
    many = F.concat(F.array_join(F.slice(head, 1, F.greatest(size - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(head, -1))
    return F.when(size == 0, F.lit("")).when(size == 1, F.get(head, F.lit(0))).otherwise(many)


def findings_text(found: DataFrame, entities: DataFrame) -> DataFrame:
    per = found.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", "phrase"))).alias("l"))
    return entities.join(per, "entity", "left").select(
        "entity",
        F.when(F.col("l").isNull(), F.lit("no single sign stands out"))
        .otherwise(list_phrase(F.col("l.phrase")))
        .alias("text"),
    )


def headline(read: DataFrame, ranked: DataFrame, on_curve: Sequence[str]) -> DataFrame:
    """Most distinctive surfaced sign plus the leading outcome, one line per entity."""
    best = read.groupBy("entity").agg(
        F.max(F.when(F.col("mentioned"), F.struct(F.col("rel").alias("r"), F.col("label").alias("l"), F.col("feature").alias("f")))).alias("b")
    )
    hook = S.percentile_phrase(F.col("b.r"), F.col("b.f").isin(list(on_curve)))
    sign = F.concat(F.lit("stands out: "), F.lower("b.l"), F.when(hook == "", F.lit("")).otherwise(F.concat(F.lit(" - "), hook)))
    lean = F.when(F.col("lead") == BALANCED, F.lit("")).otherwise(F.concat(F.lit("; leans toward "), F.col("lead")))
    return best.join(lead_of(ranked), "entity", "left").select(
        "entity",
        F.when(F.col("b").isNull(), F.lit("close to balanced")).otherwise(F.concat(sign, F.coalesce(lean, F.lit("")))).alias("headline"),
    )


def highlights(read: DataFrame, k: int = 3, floor: float = 0.15) -> DataFrame:
    """Top-k non-categorical readings above the floor, most distinctive first."""
    r = read.filter((F.col("kind") != "categorical") & (F.col("rel") > floor))
    rk = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("rel"), "feature"))
    return r.withColumn("rank", rk).filter(F.col("rank") <= k).select(
        "entity", "rank", "feature", "rel", F.floor(F.col("severity") * 100 + F.lit(0.5)).cast("int").alias("score")
    )


def balance_score(read: DataFrame) -> DataFrame:
    """100 minus 22 per unit of deviation, clipped to [40, 99]; off-default categorical signs count half."""
    part = F.when(
        F.col("kind") == "categorical",
        F.when(F.col("value") != F.col("default_value"), F.col("rel") * 0.5).otherwise(F.lit(0.0)),
    ).otherwise(F.col("rel"))
    dev = S.rnd(F.sum(part), 9)
    raw = F.floor(F.lit(100.0) - F.lit(22.0) * dev + F.lit(0.5)).cast("int")
    return read.groupBy("entity").agg(F.greatest(F.lit(40), F.least(F.lit(99), raw)).alias("balance"))


def certainty_note(read: DataFrame) -> DataFrame:
    """Sorted distinct labels of surfaced signs whose detector is only tentative."""
    lab = F.when(F.col("mentioned") & (F.col("tier_word") == "tentative"), F.lower("label"))
    return read.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set(lab)), ", ").alias("tentative"))


def recommend(found: DataFrame, ranked: DataFrame, actions: DataFrame, fallback: DataFrame, avoid: DataFrame, k: int = 3) -> DataFrame:
    """Distinct actions in finding order (at most k), else the lead outcome's first two; plus its first two to avoid.

    `actions(feature, value, action)` with `*` as any value; `fallback(outcome, pos, action)`;
    `avoid(outcome, pos, action)`. Doubted findings give no action.
    """
    f = found.filter(~F.col("doubted"))
    exact = actions.filter("value <> '*'").withColumnRenamed("action", "_x")
    anyv = actions.filter("value = '*'").select("feature", F.col("action").alias("_y"))
    mine = (
        f.join(exact, ["feature", "value"], "left")
        .join(anyv, "feature", "left")
        .withColumn("action", F.coalesce("_x", "_y"))
        .filter("action is not null")
        .groupBy("entity", "action")
        .agg(F.min("pos").alias("pos"))
        .withColumn("rn", F.row_number().over(W.partitionBy("entity").orderBy("pos")))
        .filter(F.col("rn") <= k)
        .select("entity", F.lit("do").alias("kind"), F.col("rn").alias("pos"), "action")
    )
    lead = lead_of(ranked)
    spare = (
        lead.filter(F.col("lead") != BALANCED)
        .join(mine.select("entity").distinct(), "entity", "left_anti")
        .join(fallback.filter("pos <= 2").withColumnRenamed("outcome", "lead"), "lead")
        .select("entity", F.lit("do").alias("kind"), "pos", "action")
    )
    no = lead.join(avoid.filter("pos <= 2").withColumnRenamed("outcome", "lead"), "lead").select(
        "entity", F.lit("avoid").alias("kind"), "pos", "action"
    )
    return mine.unionByName(spare).unionByName(no)


def attribute(found: DataFrame, ranked: DataFrame, effects: DataFrame, outcome_effects: DataFrame) -> DataFrame:
    """Consequences attributed to the top-four signs, first mention wins (case-insensitive).

    With fewer than four, the lead outcome's consequences are added up to six in
    all; at most ten are kept. `effects(feature, value, pos, item)` with `*` as
    any value; `outcome_effects(outcome, pos, item)`.
    """
    f = found.filter((F.col("pos") <= 4) & ~F.col("doubted")).select("entity", F.col("pos").alias("fpos"), "feature", "value")
    exact = effects.filter("value <> '*'").select("feature", "value", "pos", "item")
    anyv = effects.filter("value = '*'").select("feature", "pos", "item")
    own = f.join(exact, ["feature", "value"]).select("entity", "fpos", "pos", "item").unionByName(
        f.join(anyv, "feature").join(exact.select("feature", "value").distinct(), ["feature", "value"], "left_anti").select("entity", "fpos", "pos", "item")
    )
    own = own.groupBy("entity", F.lower("item").alias("key")).agg(F.min(F.struct("fpos", "pos", "item")).alias("m"))
    own = cut(own.select("entity", "key", F.col("m.fpos").alias("a"), F.col("m.pos").alias("b"), F.col("m.item").alias("item")))
    n_own = own.groupBy("entity").agg(F.count("*").alias("n_own"))
    extra = (
        lead_of(ranked)
        .filter(F.col("lead") != BALANCED)
        .join(n_own, "entity", "left")
        .filter(F.coalesce(F.col("n_own"), F.lit(0)) < 4)
        .join(outcome_effects.withColumnRenamed("outcome", "lead"), "lead")
        .select("entity", F.lower("item").alias("key"), F.lit(99).alias("a"), F.col("pos").alias("b"), "item")
        .join(own.select("entity", "key"), ["entity", "key"], "left_anti")
    )
    rn = F.row_number().over(W.partitionBy("entity").orderBy("a", "b", "key"))
    both = own.select("entity", "key", "a", "b", "item").unionByName(extra).withColumn("pos", rn)
    return both.filter(((F.col("a") < 99) & (F.col("pos") <= 10)) | ((F.col("a") == 99) & (F.col("pos") <= 6))).select(
        "entity", "pos", "item", F.when(F.col("a") == 99, F.lit("outcome")).otherwise(F.lit("sign")).alias("origin")
    )


def explain(ranked: DataFrame, fired: DataFrame, boosts: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of fired rules with a positive delta for each ranked outcome, in rule order."""
    pro = fired.join(boosts.filter("delta > 0"), "rule_id").join(notes.filter("note <> ''"), "rule_id")
    per = pro.groupBy("entity", "outcome").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "note"))).alias("l"))
    return ranked.join(per, ["entity", "outcome"], "left").select(
        "entity", "outcome", "rank", F.coalesce(F.array_join(F.col("l.note"), " | "), F.lit("")).alias("why")
    )


def render_lines(ranked: DataFrame, found: DataFrame) -> DataFrame:
    """Templated per-entity report: findings, then ranked outcomes with confidence."""
    a = found.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", "phrase"))).alias("f"))
    line = F.format_string("%d. %s %d%%", F.col("rank"), F.col("outcome"), F.floor(F.col("confidence") * 100 + F.lit(0.5)).cast("int"))
    b = ranked.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("o"))
    return b.join(a, "entity", "left").select(
        "entity",
        F.concat(
            F.lit("signs: "),
            F.coalesce(F.array_join(F.col("f.phrase"), ", "), F.lit("none")),
            F.lit(" / outcomes: "),
            F.array_join(F.col("o.t"), ", "),
        ).alias("report"),
    )


# ---- evidence blending -------------------------------------------------------------------


def ensemble(prior: DataFrame, evidence: DataFrame, alpha: float = 0.2, k: int = 3) -> DataFrame:
    """Blend ranked prior confidences with evidence confidences.

    `(1 - alpha) * prior + alpha * evidence`; evidence missing for a prior
    outcome is neutral (prior kept), a prior missing for an evidence outcome is 0.
    Entities with no evidence, or whose prior leads with balanced, pass through.
    """
    ev = evidence.filter(F.col("outcome") != BALANCED).select("entity", "outcome", F.col("confidence").alias("ec"), F.col("n_cites").alias("ecites"))
    has = ev.groupBy("entity").agg(F.lit(True).alias("has_ev"))
    lead = lead_of(prior).select("entity", (F.col("lead") == BALANCED).alias("bal"))
    gate = lead.join(has, "entity", "left").select("entity", (~F.col("bal") & F.coalesce("has_ev", F.lit(False))).alias("on"))
    keep = (
        prior.join(gate, "entity").filter(~F.col("on")).select(
            "entity", "outcome", "rank", "confidence", F.lit("passthrough").alias("origin"), F.lit(0).cast("bigint").alias("n_cites")
        )
    )
    p = prior.join(gate, "entity").filter("on").filter(F.col("outcome") != BALANCED).select("entity", "outcome", F.col("confidence").alias("pc"))
    e = ev.join(gate.filter("on").select("entity"), "entity", "left_semi")
    both = p.join(e, ["entity", "outcome"], "full_outer")
    pc = F.coalesce(F.col("pc"), F.lit(0.0))
    ec = F.coalesce(F.col("ec"), pc)
    b = both.select(
        "entity",
        "outcome",
        S.rnd(pc * (1 - alpha) + ec * alpha, 6).alias("confidence"),
        F.when(F.col("pc").isNull(), F.lit("evidence-added")).when(F.col("ec").isNull(), F.lit("prior")).otherwise(F.lit("ensemble")).alias("origin"),
        F.coalesce("ecites", F.lit(0)).cast("bigint").alias("n_cites"),
    )
    rk = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("confidence"), "outcome"))
    top = b.withColumn("rank", rk).filter(F.col("rank") <= k)
    cols = ["entity", "outcome", "rank", "confidence", "origin", "n_cites"]
    return top.select(*cols).unionByName(keep.select(*cols))


def validate_proposals(proposals: DataFrame, candidates: DataFrame, present: DataFrame) -> DataFrame:
    """Cite-or-abstain: a proposal must be a candidate AND rest on a detected feature.

    `proposals(entity, outcome, feature, confidence)`, one row per cited feature. A cited feature is grounded if it
    equals, contains or is contained in a detected one, whatever the case; blank ones ground nothing.
    Confidence is clamped to [0, 1], default 0.5. Every proposal comes out once
    with its status.
    """
    seen = present.groupBy("entity").agg(F.collect_set(F.lower("feature")).alias("_seen"))  # at most one per feature of the domain
    cited = F.lower(F.trim("feature"))
    fits = F.exists("_seen", lambda s: (s != "") & (cited != "") & (s.contains(cited) | cited.contains(s)))
    grounded = proposals.join(seen, "entity", "left").withColumn("g", F.when(fits, 1))
    per = grounded.groupBy("entity", "outcome").agg(
        F.max(S.clip(F.coalesce("confidence", F.lit(0.5)), 0.0, 1.0)).alias("confidence"), F.count("g").alias("n_grounded")
    )
    return per.join(
        candidates.select("entity", "outcome").withColumn("c", F.lit(1)), ["entity", "outcome"], "left"
    ).select(
        "entity",
        "outcome",
        S.rnd(F.col("confidence"), 3).alias("confidence"),
        F.when(F.col("c").isNull(), F.lit("not a candidate"))
        .when(F.col("n_grounded") == 0, F.lit("no grounded evidence"))
        .otherwise(F.lit("kept"))
        .alias("status"),
    )


def ranked_list(df: DataFrame, name: str) -> DataFrame:
    """Ordered outcome array per entity from (entity, outcome, rank); bounded by k."""
    return df.filter(F.col("outcome") != BALANCED).groupBy("entity").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "outcome"))), lambda s: s["outcome"]).alias(name)
    )


def shadow_rows(a: DataFrame, b: DataFrame, entities: DataFrame) -> DataFrame:
    """Per-entity comparison of two ranked lists: top-1 agreement and Jaccard (both empty = 1)."""
    empty = F.array().cast("array<string>")
    j = entities.join(ranked_list(a, "la"), "entity", "left").join(ranked_list(b, "lb"), "entity", "left")
    la, lb = F.coalesce("la", empty), F.coalesce("lb", empty)
    u = F.size(F.array_union(la, lb))
    return j.select(
        "entity",
        F.size(F.array_intersect(la, lb)).alias("n_common"),
        u.alias("n_union"),
        F.coalesce(F.get(la, F.lit(0)) == F.get(lb, F.lit(0)), F.lit(False)).alias("top1"),
        F.when(u == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(la, lb)) / F.nullif(u, F.lit(0))).alias("jaccard"),
        (F.size(la) == 0).alias("abstain"),
    )


def shadow_summary(rows: DataFrame, validated: DataFrame) -> DataFrame:
    """Agreement rates over all entities; an entity counts as rejected if any proposal was dropped."""
    bad = validated.filter("status <> 'kept'").select("entity").distinct().withColumn("rejected", F.lit(True))
    rows = rows.join(bad, "entity", "left").na.fill(False, ["rejected"])
    rate = lambda c: S.rnd(F.avg(F.col(c).cast("int")), 6)
    return rows.agg(
        F.count("*").alias("n"),
        rate("top1").alias("top1_agreement"),
        S.rnd(F.avg("jaccard"), 6).alias("mean_jaccard"),
        rate("abstain").alias("abstain_rate"),
        rate("rejected").alias("reject_rate"),
    )


def ensemble_summary(prior: DataFrame, blended: DataFrame, validated: DataFrame) -> DataFrame:
    """Stability of the lead, share of leads with citations, coverage, added and reject rates.

    An entity counts as rejected if the validation dropped any of its proposals.
    """
    bad = validated.filter("status <> 'kept'").select("entity").distinct().withColumn("rejected", F.lit(1))
    p = prior.filter(F.col("outcome") != BALANCED).groupBy("entity").agg(F.min_by("outcome", "rank").alias("ptop"))
    b = blended.groupBy("entity").agg(
        F.min_by("outcome", "rank").alias("btop"),
        F.min_by((F.col("n_cites") > 0).cast("int"), "rank").alias("lead_cited"),
        F.avg((F.col("n_cites") > 0).cast("int")).alias("cov"),
        F.max((F.col("origin") == "evidence-added").cast("int")).alias("added"),
    )
    return b.join(p, "entity", "left").join(bad, "entity", "left").agg(
        F.count("*").alias("n"),
        S.rnd(F.avg((F.col("btop") == F.coalesce("ptop", F.lit(""))).cast("int")), 6).alias("stability"),
        S.rnd(F.avg("lead_cited"), 6).alias("lead_cited"),
        S.rnd(F.avg("cov"), 6).alias("coverage"),
        S.rnd(F.avg("added"), 6).alias("added_rate"),
        S.rnd(F.avg(F.coalesce("rejected", F.lit(0))), 6).alias("reject_rate"),
    )


def match_cards(present: DataFrame, cards: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cards whose conditions all hold, most specific (most conditions) first.

    `cards(card_id, feature, value)`, `sizes(card_id, n_cond)`.
    """
    m = (
        present.join(cards, ["feature", "value"])
        .groupBy("entity", "card_id")
        .agg(F.count("*").alias("hits"))
        .join(sizes, "card_id")
        .filter(F.col("hits") == F.col("n_cond"))
    )
    rk = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("n_cond"), "card_id"))
    return m.select("entity", "card_id", F.col("n_cond").alias("specificity"), rk.alias("rank"))


def missing_domain(observed: DataFrame, entities: DataFrame, domain: Sequence[str]) -> DataFrame:
    """Domain features an entity has no row for. The domain is a literal list, so the
    spine is exploded in place and compared with one co-partitioned anti join."""
    spine = entities.select("entity", F.explode(F.array(*[F.lit(d) for d in domain])).alias("feature"))
    return spine.join(observed.select("entity", "feature").distinct(), ["entity", "feature"], "left_anti")


def complete_absent(observed: DataFrame, entities: DataFrame, domain: Sequence[str]) -> DataFrame:
    """Closed-world completion: explicit `absent` for unseen binary features.

    `observed(entity, feature, value, class_id)`; with several classes for one
    feature the highest class id wins.
    """
    seen = observed.groupBy("entity", "feature").agg(F.max_by("value", "class_id").alias("value"))
    gone = missing_domain(seen, entities, domain).withColumn("value", F.lit("absent"))
    return seen.unionByName(gone)
