"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from heron.llm import bpe, exact_dedup, fingerprints, language_id, lm_scoring, ngram_join, packing, pii, repeats, sharding

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_language_id": language_id.op3_language_id,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_pii": pii.op6_pii,
    "op7_sharding": sharding.op7_sharding,
    "op8_bpe": bpe.op8_bpe,
    "op9_suffix_dedup": repeats.op9_suffix_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLE_SQL = {"op2_ngram_jaccard": ngram_join.SQL, "op10_exact_dedup": exact_dedup.SQL}
