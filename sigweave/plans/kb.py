"""Literal knowledge tables used by the registered queries (our own example content)."""

from __future__ import annotations

from sigweave.dims import Dim

OUTCOMES = ["churn", "dormant", "friction", "growth", "loyalty"]
VALUES = ["low", "mid", "high"]

# kind: how the sign is treated; reliability: vote factor of extra signs;
# trust: display weight of the detector; tier: display priority.
FEATURES = Dim(
    "features",
    [
        ("feature", "string"),
        ("kind", "string"),
        ("default_value", "string"),
        ("tier_word", "string"),
        ("reliability", "double"),
        ("trust", "double"),
        ("tier", "int"),
        ("label", "string"),
    ],
    [
        ("click", "graded", "low", "reliable", 1.0, 1.0, 0, "Click rate"),
        ("view", "graded", "low", "moderate", 1.0, 0.6, 0, "View depth"),
        ("purchase", "extra", "low", "tentative", 0.68, 0.45, 1, "Purchase size"),
        ("error", "categorical", "mid", "reliable", 1.0, 1.0, 0, "Error mix"),
        ("signup", "zone", "low", "tentative", 1.0, 0.45, 2, "Signup burst"),
    ],
)
FEATURE_NAMES = FEATURES.column("feature")
CURVED = ["click", "view", "purchase"]
CATEGORICAL = [("error", v) for v in VALUES]

VOTES = Dim(
    "votes",
    [("feature", "string"), ("value", "string"), ("outcome", "string"), ("weight", "double")],
    [
        ("click", "present", "growth", 0.9),
        ("click", "present", "loyalty", 0.5),
        ("view", "present", "growth", 0.4),
        ("view", "present", "dormant", 0.7),
        ("purchase", "present", "loyalty", 1.1),
        ("purchase", "present", "growth", 0.3),
        ("error", "low", "loyalty", 0.3),
        ("error", "mid", "balanced", 0.5),
        ("error", "high", "friction", 0.9),
        ("error", "high", "churn", 0.4),
        ("signup", "present", "churn", 0.4),
        ("signup", "present", "friction", 0.3),
    ],
)

RULE_NEEDS = Dim(
    "rule_needs",
    [("rule_id", "string"), ("rule_ord", "int"), ("n_when", "int"), ("n_any", "int"), ("enabled", "int")],
    [
        ("hot_click", 1, 1, 0, 1),
        ("quiet", 2, 2, 0, 1),
        ("rough", 3, 1, 2, 1),
        ("engaged", 4, 1, 0, 1),
        ("unproven", 5, 1, 0, 0),
        ("either", 6, 0, 2, 1),
    ],
)
RULE_CONDITIONS = Dim(
    "rule_conditions",
    [("rule_id", "string"), ("grp", "string"), ("feature", "string"), ("value", "string")],
    [
        ("hot_click", "when", "click", "high"),
        ("quiet", "when", "click", "low"),
        ("quiet", "when", "view", "low"),
        ("rough", "when", "error", "high"),
        ("rough", "any", "signup", "present"),
        ("rough", "any", "purchase", "present"),
        ("engaged", "when", "view", "mid"),
        ("engaged", "when", "view", "high"),
        ("unproven", "when", "error", "mid"),
        ("either", "any", "purchase", "present"),
        ("either", "any", "click", "mid"),
    ],
)
RULE_BOOSTS = Dim(
    "rule_boosts",
    [("rule_id", "string"), ("outcome", "string"), ("delta", "double")],
    [
        ("hot_click", "growth", 0.5),
        ("hot_click", "churn", -0.3),
        ("quiet", "dormant", 0.6),
        ("quiet", "growth", -0.9),
        ("rough", "friction", 0.4),
        ("rough", "loyalty", -0.7),
        ("engaged", "growth", 0.4),
        ("engaged", "churn", -0.6),
        ("unproven", "churn", 2.0),
        ("either", "loyalty", 0.3),
        ("either", "churn", 0.2),
    ],
)
RULE_NOTES = Dim(
    "rule_notes",
    [("rule_id", "string"), ("note", "string")],
    [
        ("hot_click", "heavy clicking suggests growth"),
        ("quiet", "few clicks and shallow views suggest dormancy"),
        ("rough", "errors beside activity suggest friction"),
        ("engaged", "deep views suggest growth"),
        ("unproven", "kept for provenance"),
        ("either", ""),
    ],
)

BANDS = [(0.25, "slight"), (0.5, "moderate"), (0.75, "marked"), (1.0, "strong")]

PHRASES = Dim(
    "phrases",
    [("feature", "string"), ("value", "string"), ("phrase", "string")],
    [
        ("click", "*", "frequent clicks"),
        ("view", "*", "deep views"),
        ("view", "high", "very deep views"),
        ("purchase", "*", "large purchases"),
        ("error", "high", "many severe errors"),
        ("error", "low", "few severe errors"),
        ("signup", "*", "a signup burst"),
    ],
)
CAVEAT = ("click", "error", "high", "high", "clicks possibly caused by errors")

ACTIONS = Dim(
    "actions",
    [("feature", "string"), ("value", "string"), ("action", "string")],
    [
        ("click", "*", "offer the next step"),
        ("view", "high", "show related items"),
        ("view", "*", "show a summary"),
        ("purchase", "*", "offer the loyalty plan"),
        ("error", "high", "open a support case"),
    ],
)
FALLBACK = Dim(
    "fallback",
    [("outcome", "string"), ("pos", "int"), ("action", "string")],
    [(o, i, f"{o} plan step {i}") for o in OUTCOMES for i in (1, 2, 3)],
)
AVOID = Dim(
    "avoid",
    [("outcome", "string"), ("pos", "int"), ("action", "string")],
    [(o, i, f"{o} trap {i}") for o in [*OUTCOMES, "balanced"] for i in (1, 2, 3)],
)
EFFECTS = Dim(
    "effects",
    [("feature", "string"), ("value", "string"), ("pos", "int"), ("item", "string")],
    [
        ("click", "*", 1, "short visits"),
        ("click", "*", 2, "Many tabs"),
        ("view", "high", 1, "long visits"),
        ("view", "*", 1, "many tabs"),
        ("view", "*", 2, "late visits"),
        ("purchase", "*", 1, "full baskets"),
        ("error", "high", 1, "repeat calls"),
        ("error", "high", 2, "Short visits"),
        ("signup", "*", 1, "new devices"),
    ],
)
OUTCOME_EFFECTS = Dim(
    "outcome_effects",
    [("outcome", "string"), ("pos", "int"), ("item", "string")],
    [(o, i, f"{o} effect {i}") for o in OUTCOMES for i in range(1, 8)] + [("growth", 8, "short visits")],
)
CARD_CONDITIONS = Dim(
    "card_conditions",
    [("card_id", "string"), ("feature", "string"), ("value", "string")],
    [
        ("c_one", "error", "mid"),
        ("c_two", "error", "mid"),
        ("c_two", "click", "mid"),
        ("c_three", "error", "mid"),
        ("c_three", "click", "mid"),
        ("c_three", "view", "mid"),
        ("c_buy", "purchase", "present"),
        ("c_hot", "click", "high"),
    ],
)
CARD_SIZES = Dim(
    "card_sizes",
    [("card_id", "string"), ("n_cond", "int")],
    [("c_one", 1), ("c_two", 2), ("c_three", 3), ("c_buy", 1), ("c_hot", 1)],
)
# Baseline class of each outcome.
BASELINE = Dim(
    "baseline",
    [("outcome", "string"), ("baseline_class", "string")],
    [("churn", "declining"), ("dormant", "declining"), ("friction", "strained"), ("growth", "rising"), ("balanced", "steady")],
)
