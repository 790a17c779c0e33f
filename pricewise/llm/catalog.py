"""Registered queries of the operators and their SQL twins."""

from __future__ import annotations

from . import (alignment, chat, fingerprints, manifest, mixing_lm, near_dedup, packing, piece_codec, quality,
               source_mix, token_counts, topk, toxicity)

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_chat_format": chat.op2_chat_format,
    "op3_quality": quality.op3_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_piece_codec": piece_codec.op5_piece_codec,
    "op6_mixing_lm": mixing_lm.op6_mixing_lm,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_source_mix": source_mix.op9_source_mix,
    "op10_topk_search": topk.op10_topk_search,
    "op11_packing": packing.op11_packing,
    "op12_alignment": alignment.op12_alignment,
    "op13_manifest": manifest.op13_manifest,
}

SQL = {
    "op2_chat_format": chat.SQL,
    "op9_source_mix": source_mix.SQL,
    "op13_manifest": manifest.SQL,
}
