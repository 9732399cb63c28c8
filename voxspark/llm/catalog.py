"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, contamination, jaccard, lm_scoring, merkle, mixing, perspectives, quality, secrets, sharding, simhash, token_planes, warc

QUERIES = {
    "op1_perspective_rotation": perspectives.op1_perspective_rotation,
    "op2_token_planes": token_planes.op2_token_planes,
    "op3_benchmark_containment": contamination.op3_benchmark_containment,
    "op4_warc_bundles": warc.op4_warc_bundles,
    "op5_recurrent_scores": lm_scoring.op5_recurrent_scores,
    "op6_rendezvous_sharding": sharding.op6_rendezvous_sharding,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_soft_mixing": mixing.op10_soft_mixing,
    "op11_simhash_trie": simhash.op11_simhash_trie,
    "op12_merkle_witnesses": merkle.op12_merkle_witnesses,
    "op13_token_alignment": alignment.op13_token_alignment,
}
SQL = {
    "op1_perspective_rotation": perspectives.ORACLE,
    "op3_benchmark_containment": contamination.ORACLE,
    "op4_warc_bundles": warc.ORACLE,
    "op8_jaccard_join": jaccard.ORACLE,
    "op12_merkle_witnesses": merkle.ORACLE,
}
