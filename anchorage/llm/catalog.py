"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

import corpus_pipeline
from anchorage.llm import alignment, chat, jaccard_join, merkle, mixing, packing, pii, repetition, secrets, site_tree, spotsigs, substring_dedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_spotsigs": spotsigs.op6_spotsigs,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": repetition.op10_quality_rules,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_site_style_tree": site_tree.op12_site_style_tree,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op2_source_mixing": mixing.OP2_SQL,
    "op4_ngram_jaccard_join": jaccard_join.OP4_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op10_quality_rules": repetition.OP10_SQL,
    "op12_site_style_tree": site_tree.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
