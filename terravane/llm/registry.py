"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_tree, decontamination, jaccard_join, language_id, lexical_search, line_dedup, lm_scoring, periodic_runs, piece_sampling, quality_classifier, quality_rules, substring_dedup, token_counts

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_sentencepiece_sampling": piece_sampling.op3_sentencepiece_sampling,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_chat_tree": chat_tree.op11_chat_tree,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLES = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_chat_tree": chat_tree.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}
