"""The registered queries of this package and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from . import chat, decontaminate, fingerprint, line_dedup, near_dup, packing, sharding, suffix_dedup, token_count, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_document_fingerprints": fingerprint.op3_document_fingerprints,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_packing": packing.op5_packing,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_sharding": sharding.op7_sharding,
    "op8_suffix_array_dedup": suffix_dedup.op8_suffix_array_dedup,
    "op9_token_counts": token_count.op9_token_counts,
    "op10_ngram_jaccard_join": near_dup.op10_ngram_jaccard_join,
}
ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_chat_formatting": chat.OP2_SQL,
    "op6_benchmark_decontamination": decontaminate.OP6_SQL,
    "op7_sharding": sharding.OP7_SQL,
    "op10_ngram_jaccard_join": near_dup.OP10_SQL,
}
