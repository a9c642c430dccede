"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from keystrata.llm import (
    decontamination,
    jaccard_join,
    language_id,
    license_scan,
    line_dedup,
    quality_resampling,
    secret_scan,
    source_mixing,
    substring_dedup,
    topk_search,
)

QUERIES = {
    "op1_source_mixing": source_mixing.query,
    "op2_line_dedup": line_dedup.query,
    "op3_license_scan": license_scan.query,
    "op4_quality_resampling": quality_resampling.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_decontamination": decontamination.query,
    "op7_secret_scan": secret_scan.query,
    "op8_language_id": language_id.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_topk_search": topk_search.query,
}
SQL = {
    "op1_source_mixing": source_mixing.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op6_decontamination": decontamination.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op10_topk_search": topk_search.SQL,
}
