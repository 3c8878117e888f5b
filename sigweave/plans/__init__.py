"""All registered queries; importing this package registers them."""

from sigweave.plans import behaviour, flows, imaging, knowledge, labelling, texts  # noqa: F401
from sigweave.plans.base import ORACLES, QUERIES, typed

# The SQL engine sums integers to 128 bits and sizes lists in 64; these columns get the Spark type.
for _name, _types in {
    "a11_multiclass": {"n": "BIGINT"},
    "a15_calibrate_cut": {"n": "BIGINT"},
    "a13_average_precision": {"n": "BIGINT", "n_pos": "BIGINT"},
    "a23_axis_recall": {"n_hit": "BIGINT"},
    "a26_faithfulness": {"claims": "BIGINT", "supported": "BIGINT"},
    "a27_hit_at_k": {"n_hit": "BIGINT"},
    "f4_redact": {"n": "INTEGER"},
    "g9_rank_evidence": {"n_cites": "BIGINT"},
    "g11_match_fallback": {"n_cites": "BIGINT"},
    "j11_ensemble": {"n_cites": "BIGINT"},
    "j17_axis_match": {"n_ours": "INTEGER", "n_gold": "INTEGER"},
    "r2_cosine_topk": {"query_id": "BIGINT"},
    "src7_slice_sections": {"n": "INTEGER"},
    "st2_stream_refine": {"n_answers": "BIGINT"},
    "u4_list_overlap": {"n_common": "INTEGER", "n_union": "INTEGER"},
    "w3_last_per_key": {"pos": "INTEGER"},
}.items():
    ORACLES[_name] = typed(ORACLES[_name], _types)

__all__ = ["ORACLES", "QUERIES"]
