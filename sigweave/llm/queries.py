"""The registered queries of this folder and their SQL equivalents."""

from __future__ import annotations

from sigweave.llm import byte_bpe, exact_dedup, jaccard_join, lsh_search, packing, pii, prefix_trie, quality, spelling, suffix_dedup
from sigweave.llm import token_counts, url_reputation, va_search

QUERIES = {
    "op1_nb_svm": quality.op1_nb_svm,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_bilstm_pii": pii.op3_bilstm_pii,
    "op4_lsh_search": lsh_search.op4_lsh_search,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_url_reputation": url_reputation.op6_url_reputation,
    "op7_pack": packing.op7_pack,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_va_search": va_search.op10_va_search,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op6_url_reputation": url_reputation.OP6_SQL,
    "op10_va_search": va_search.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_exact_dedup": exact_dedup.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
