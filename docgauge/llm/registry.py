"""The queries of this subpackage and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from docgauge.llm import byte_bpe, exact_dedup, html_text, jaccard_join, language_model, packing, quality_model, quality_rules, secrets, substring_dedup

QUERIES = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_language_model": language_model.query,
    "op3_packing": packing.query,
    "op4_html_text": html_text.query,
    "op5_quality_rules": quality_rules.query,
    "op6_secret_scan": secrets.query,
    "op7_quality_model": quality_model.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_jaccard_join": jaccard_join.query,
}

ORACLE_SQL = {
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_jaccard_join": jaccard_join.ORACLE_SQL,
}
