"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quillspark.llm import (
    best_fit_packing,
    chat_formatting,
    fingerprints,
    hilbert_sharding,
    id_files,
    jaccard_join,
    language_id,
    line_dedup,
    phrase_mining,
    quality_rules,
    source_mixing,
    substring_dedup,
    vector_codes,
)

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_language_id": language_id.query,
    "op3_line_dedup": line_dedup.query,
    "op4_best_fit_packing": best_fit_packing.query,
    "op5_source_mixing": source_mixing.query,
    "op6_hilbert_sharding": hilbert_sharding.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_chat_formatting": chat_formatting.query,
    "op9_fingerprints": fingerprints.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_id_files": id_files.query,
    "op12_phrase_mining": phrase_mining.query,
    "op13_vector_codes": vector_codes.query,
}

ORACLE_SQL = {"op3_line_dedup": line_dedup.ORACLE, "op12_phrase_mining": phrase_mining.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
