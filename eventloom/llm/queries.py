"""The registered queries of this subpackage."""

from __future__ import annotations

from eventloom.llm import (
    ball_kmeans,
    best_fit_packing,
    compression_quality,
    context_tree,
    piece_codec,
    preference_chat,
    projection_forest,
    quality_rules,
    revisits,
    simhash_neardup,
    source_mix,
    substring_dedup,
    whitening,
)

QUERIES = {
    "op1_compression_quality": compression_quality.query,
    "op2_quality_rules": quality_rules.query,
    "op3_context_tree": context_tree.query,
    "op4_projection_forest": projection_forest.query,
    "op5_source_mix": source_mix.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_piece_codec": piece_codec.query,
    "op8_preference_chat": preference_chat.query,
    "op9_simhash_neardup": simhash_neardup.query,
    "op10_revisits": revisits.query,
    "op11_ball_kmeans": ball_kmeans.query,
    "op12_best_fit_packing": best_fit_packing.query,
    "op13_whitening": whitening.query,
}

ORACLES: dict[str, str] = {
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op8_preference_chat": preference_chat.ORACLE,
    "op10_revisits": revisits.ORACLE,
    "op11_ball_kmeans": ball_kmeans.ORACLE,
}
