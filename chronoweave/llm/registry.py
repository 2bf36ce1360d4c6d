"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from chronoweave.llm import centroids, chat, divergence, exact_dedup, licenses, line_dedup, media, minhash, mixing, packing, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_flac_media": media.op4_flac_media,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_preference_format": chat.op7_preference_format,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_shard_documents": sharding.op12_shard_documents,
    "op13_centroid_clusters": centroids.op13_centroid_clusters,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_minhash_near_dedup": minhash.ORACLE,
    "op7_preference_format": chat.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op13_centroid_clusters": centroids.ORACLE,
}
