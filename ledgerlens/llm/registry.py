"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, decontaminate, html_text, jaccard_join, langid, maxent_lm, sentencepieces, substring_dedup, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_maxent_lm": maxent_lm.op2_maxent_lm,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_html_text": html_text.op4_html_text,
    "op5_sentencepiece": sentencepieces.op5_sentencepiece,
    "op6_language_id": langid.op6_language_id,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_learned_partitions": ann.op8_learned_partitions,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}
ORACLE_SQL = {
    "op1_url_filters": url_filters.ORACLE_SQL,
    "op7_substring_dedup": substring_dedup.ORACLE_SQL,
    "op9_decontamination": decontaminate.ORACLE_SQL,
    "op10_jaccard_join": jaccard_join.ORACLE_SQL,
}
