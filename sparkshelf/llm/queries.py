"""The queries of the ten operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, hilbert_ann, line_dedup, lm_score, simhash_dedup, span_dedup, token_counts, toxicity, url_rules

QUERIES = {
    "op1_lm_scoring": lm_score.op1_lm_scoring,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_substring_dedup": span_dedup.op4_substring_dedup,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_hilbert_ann": hilbert_ann.op7_hilbert_ann,
    "op8_simhash_dedup": simhash_dedup.op8_simhash_dedup,
    "op9_url_filters": url_rules.op9_url_filters,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}

SQL: dict[str, str] = {"op9_url_filters": url_rules.OP9_SQL}
