"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import decontamination, exact_dedup, fill_in_middle, filter_audit, language_id, license_scan, line_dedup, lm_scoring, packing, quality, sharding, simhash, token_counts

QUERIES = {
    "op3_decontamination": decontamination.op3_decontamination,
    "op6_license_scan": license_scan.op6_license_scan,
    "op2_language_id": language_id.op2_language_id,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_quality_classifier": quality.op12_quality_classifier,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op6_license_scan": license_scan.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
