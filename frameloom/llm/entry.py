"""Queries and SQL of this subpackage for __spark_entry__.py."""

from __future__ import annotations

from . import ann, hard_negatives, minhash, mixing, outliers, packing, periodic_runs, pii, quality, recompression, suffix_dedup, token_store, toxicity

QUERIES = {
    "op1_nearest_neighbours": ann.op1,
    "op2_mix_sources": mixing.op2,
    "op3_robust_outliers": outliers.op3,
    "op4_repeated_strings": suffix_dedup.op4,
    "op5_toxicity": toxicity.op5,
    "op6_near_duplicates": minhash.op6,
    "op7_personal_data": pii.op7,
    "op8_pack_best_fit": packing.op8,
    "op9_quality": quality.op9,
    "op10_token_store": token_store.op10,
    "op11_periodic_runs": periodic_runs.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_earlier_passages": recompression.op13,
}
ORACLES = {"op2_mix_sources": mixing.OP2_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL, "op13_earlier_passages": recompression.OP13_SQL}
