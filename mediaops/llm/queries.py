"""Queries of the operators and of the pipeline, with SQL where SQL can say it."""

from __future__ import annotations

from mediaops.llm import language, minhash, mixing, neighbours, packing, pii, prefixes, quality, sharding, substrings, topk, toxicity, whitening
from mediaops.llm.common import prepare


def _query(f):
    return lambda spark, sf_dir: f(prepare(spark), sf_dir)


QUERIES = {
    name: _query(f)
    for name, f in {
        "op1_near_duplicates": minhash.op1_near_duplicates,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_language_id": language.op3_language_id,
        "op4_near_vectors": neighbours.op4_near_vectors,
        "op5_exact_top_k": topk.op5_exact_top_k,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_quality_scores": quality.op7_quality_scores,
        "op8_shard_documents": sharding.op8_shard_documents,
        "op9_pack_documents": packing.op9_pack_documents,
        "op10_substring_dedup": substrings.op10_substring_dedup,
        "op11_personal_data": pii.op11_personal_data,
        "op12_prefix_trie": prefixes.op12_prefix_trie,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }.items()
}

ORACLE_SQL = {
    "op1_near_duplicates": minhash.OP1_SQL,
    "op4_near_vectors": neighbours.OP4_SQL,
    "op5_exact_top_k": topk.OP5_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op10_substring_dedup": substrings.OP10_SQL,
    "op12_prefix_trie": prefixes.OP12_SQL,
}
