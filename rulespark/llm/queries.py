"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontamination, html_extract, jaccard_join, license_scan, line_dedup, lm_score, packing, quality_rules, sharding

QUERIES = {
    "op1_lm_score": lm_score.query,
    "op2_license_scan": license_scan.query,
    "op3_quality_rules": quality_rules.query,
    "op4_html_extract": html_extract.query,
    "op5_sharding": sharding.query,
    "op6_chat_format": chat_format.query,
    "op7_decontamination": decontamination.query,
    "op8_packing": packing.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_line_dedup": line_dedup.query,
}

ORACLES = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
