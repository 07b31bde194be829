"""Registered queries of this package and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from fieldquarry.llm import hnsw, licenses, lm, media, mixing, neardup, packing, quality, ranking, secrets, sharding, turns, warc


def queries() -> dict:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_hnsw_neardup": hnsw.op2_hnsw_neardup,
        "op3_lm_score": lm.op3_lm_score,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_bagminhash_dedup": neardup.op6_bagminhash_dedup,
        "op7_matroska": media.op7_matroska,
        "op8_pack_documents": packing.op8_pack_documents,
        "op9_shard_documents": sharding.op9_shard_documents,
        "op10_quality": quality.op10_quality,
        "op11_warc_history": warc.op11_warc_history,
        "op12_conversation_repair": turns.op12_conversation_repair,
        "op13_ranked_search": ranking.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mix_sources": mixing.oracle(),
        "op5_secret_scan": secrets.oracle(),
        "op9_shard_documents": sharding.oracle(),
        "op11_warc_history": warc.oracle(),
        "op12_conversation_repair": turns.oracle(),
        "op13_ranked_search": ranking.oracle(),
    }
