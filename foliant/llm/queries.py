"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from . import fingerprints, jaccard, langid, mixing, packing, quality, sharding, suffixes, vectors, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_packing": packing.op2_packing,
    "op3_near_vectors": vectors.op3_near_vectors,
    "op4_mixing": mixing.op4_mixing,
    "op5_sharding": sharding.op5_sharding,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_language_id": langid.op7_language_id,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_quality": quality.op9_quality,
}
ORACLES = {"op1_warc": warc.ORACLE, "op10_jaccard_join": jaccard.ORACLE, "op3_near_vectors": vectors.ORACLE, "op4_mixing": mixing.ORACLE}
