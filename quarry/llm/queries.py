"""Queries of the training-data operators. Those without SQL here depend on tokenizers or
models, or are approximate by contract; tests hold them against brute force."""

from __future__ import annotations

from quarry.llm import byte_bpe, chat, jaccard_join, maxent, oracles, packing, quality, token_output, toxicity, vector_dedup, vector_search


def queries() -> dict:
    return {
        "op1_simple8b_tokens": token_output.op1,
        "op2_compression_toxicity": toxicity.op2,
        "op3_prefix_target_chat": chat.op3,
        "op4_bitmap_queue_bpe": byte_bpe.op4,
        "op5_best_fit_packing": packing.op5,
        "op6_hashed_maxent": maxent.op6,
        "op7_parity_sketch_join": jaccard_join.op7,
        "op8_permutation_index": vector_search.op8,
        "op9_collision_projections": vector_dedup.op9,
        "op10_attention_quality": quality.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_prefix_target_chat": oracles.OP3,
        "op7_parity_sketch_join": oracles.OP7,
        "op9_collision_projections": oracles.OP9,
    }
