"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from phenogrid.llm import ann, bpe, clusters, exact_dedup, html_text, lm, mixing, near_dedup, pii, quality, rules, substring_dedup, trie

QUERIES = {
    "op1_learned_partitions": ann.op1_learned_partitions,
    "op2_log_bilinear": lm.op2_log_bilinear,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_debruijn_repeats": substring_dedup.op4_debruijn_repeats,
    "op5_nbsvm_quality": quality.op5_nbsvm_quality,
    "op6_pii": pii.op6_pii,
    "op7_dart_minhash": near_dedup.op7_dart_minhash,
    "op8_curriculum_mix": mixing.op8_curriculum_mix,
    "op9_layout_text": html_text.op9_layout_text,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_quality_rules": rules.op11_quality_rules,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_rotated_clusters": clusters.op13_rotated_clusters,
}

SQL = {
    "op4_debruijn_repeats": substring_dedup.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op8_curriculum_mix": mixing.SQL,
    "op12_prefix_trie": trie.SQL,
    "op13_rotated_clusters": clusters.SQL,
}
