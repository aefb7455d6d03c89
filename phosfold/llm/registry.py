"""Queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from . import alignment, bpe, decontaminate, huffman, interleave, negatives, quality, sharding, simhash, substring_dedup, suffix_dedup, toxicity, url_rules

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_huffman": huffman.op2_huffman,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_sharding": sharding.op4_sharding,
    "op5_url_rules": url_rules.op5_url_rules,
    "op6_interleave": interleave.op6_interleave,
    "interleaved_pages": interleave.interleaved_pages,
    "op7_quality": quality.op7_quality,
    "op8_bpe": bpe.op8_bpe,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_simhash": simhash.op10_simhash,
    "op11_alignment": alignment.op11_alignment,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}

SQL: dict[str, str] = {"op12_hard_negatives": negatives.OP12_SQL}
