"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, hard_negatives, language_id, lattice_lm, license_scan, mixing, phrases, private_spans, quality_crf, simhash, substring_dedup, url_filter

QUERIES = {
    "op1_simhash_dedup": simhash.op1_simhash_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_language_id": language_id.op4_language_id,
    "op5_quality_crf": quality_crf.op5_quality_crf,
    "op6_lm_score": lattice_lm.op6_lm_score,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_personal_data": private_spans.op11_personal_data,
    "op12_phrases": phrases.op12_phrases,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op3_mix_sources": mixing.ORACLE_SQL,
    "op7_license_scan": license_scan.ORACLE_SQL,
    "op8_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
    "op10_url_filter": url_filter.ORACLE_SQL,
    "op12_phrases": phrases.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
