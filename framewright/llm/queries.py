"""The queries of this package by name, with the SQL that gives the same rows."""

from __future__ import annotations

import corpus_pipeline
from framewright.llm import decontaminate, html_text, jaccard_join, language_id, lexical_search, line_dedup, metric_tree, mixing, quality_rules, sharding, suffix_dedup, token_files, vector_codes

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_line_chunks": line_dedup.op2_line_chunks,
    "op3_run_index": suffix_dedup.op3_run_index,
    "op4_token_files": token_files.op4_token_files,
    "op5_fm_index_decontamination": decontaminate.op5_fm_index_decontamination,
    "op6_rank_order_language": language_id.op6_rank_order_language,
    "op7_hash_tree": sharding.op7_hash_tree,
    "op8_temperature_mixture": mixing.op8_temperature_mixture,
    "op9_jaccard_components": jaccard_join.op9_jaccard_components,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_metric_tree": metric_tree.op11_metric_tree,
    "op12_automaton_ranking": lexical_search.op12_automaton_ranking,
    "op13_walsh_codes": vector_codes.op13_walsh_codes,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op3_run_index": suffix_dedup.OP3_SQL,
    "op5_fm_index_decontamination": decontaminate.OP5_SQL,
    "op7_hash_tree": sharding.OP7_SQL,
    "op8_temperature_mixture": mixing.OP8_SQL,
    "op9_jaccard_components": jaccard_join.OP9_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_metric_tree": metric_tree.OP11_SQL,
    "op12_automaton_ranking": lexical_search.OP12_SQL,
    "op13_walsh_codes": vector_codes.OP13_SQL,
}
