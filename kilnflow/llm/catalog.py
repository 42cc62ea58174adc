"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from kilnflow.llm import (
    bpe,
    chat,
    codes,
    exact,
    language,
    licenses,
    mixing,
    neardup,
    negatives,
    pii,
    quality,
    shards,
    topk,
)

QUERIES = {
    "op1_personal_data": pii.op1_personal_data,
    "op2_fair_queue_mix": mixing.op2_fair_queue_mix,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_hash_tree_shards": shards.op4_hash_tree_shards,
    "op5_quality": quality.op5_quality,
    "op6_language": language.op6_language,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_block_max_top_k": topk.op8_block_max_top_k,
    "op9_weighted_near_dedup": neardup.op9_weighted_near_dedup,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_trie_codes": codes.op12_trie_codes,
    "op13_chat_windows": chat.op13_chat_windows,
}

SQL = {
    "op2_fair_queue_mix": mixing.OP2_SQL,
    "op3_license_scan": licenses.OP3_SQL,
    "op4_hash_tree_shards": shards.OP4_SQL,
    "op8_block_max_top_k": topk.OP8_SQL,
    "op10_exact_dedup": exact.OP10_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_trie_codes": codes.OP12_SQL,
}
