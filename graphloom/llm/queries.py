"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, filter_audit, fim, langid, mixing, outliers, phrase_dedup, quality, simhash, suffix_dedup, token_counts, token_store, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_outliers": outliers.op3_outliers,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_language_id": langid.op6_language_id,
    "op7_token_ids": token_store.op7_token_ids,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash": simhash.op9_simhash,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_phrase_dedup": phrase_dedup.op11_phrase_dedup,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

SQL = {
    "op5_suffix_dedup": suffix_dedup.OP5_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op10_decontamination": decontam.OP10_SQL,
    "op11_phrase_dedup": phrase_dedup.OP11_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
