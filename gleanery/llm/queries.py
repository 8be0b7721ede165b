"""The operators' queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, embeddings, language_model, media, mixing, negatives, pieces, quality, repair, sharding, simhash, token_codes, url_filter

QUERIES = {
    "op1_gru_score": language_model.op1_gru_score,
    "op2_url_rules": url_filter.op2_url_rules,
    "op3_curriculum_mix": mixing.op3_curriculum_mix,
    "op4_simhash": simhash.op4_simhash,
    "op5_media_chunks": media.op5_media_chunks,
    "op6_pca_tiles": embeddings.op6_pca_tiles,
    "op7_feistel_shards": sharding.op7_feistel_shards,
    "op8_chat_masks": chat.op8_chat_masks,
    "op9_nbest_pieces": pieces.op9_nbest_pieces,
    "op10_quality": quality.op10_quality,
    "op11_addressable_codes": token_codes.op11_addressable_codes,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_astar_repair": repair.op13_astar_repair,
}
ORACLE = {"op2_url_rules": url_filter.SQL, "op6_pca_tiles": embeddings.SQL, "op8_chat_masks": chat.SQL, "op12_hard_negatives": negatives.SQL, "op13_astar_repair": repair.SQL}
