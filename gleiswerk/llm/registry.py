"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, conversations, html_extract, jaccard_join, language_id, license_scan, line_dedup, media, packing, quality, spelling, substring_dedup, suffix_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_media": media.op2_media,
    "op3_language_id": language_id.op3_language_id,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_packing": packing.op7_packing,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_bpe": bpe.op10_bpe,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_spelling": spelling.op12_spelling,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}
#: SQL for what it can express; tests compare the others with brute force.
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op5_suffix_dedup": suffix_dedup.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op11_conversation_repair": conversations.SQL,
    "op12_spelling": spelling.SQL,
    "op13_substring_dedup": substring_dedup.SQL,
}
