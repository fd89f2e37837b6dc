"""The subpackage's queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import difference_cover, hnsw_dedup, importance_resampling, langid, license_scan, mixing, packing, sharding, simhash, source_divergence, suffix_dedup, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each runs over its whole tables."""
    return {
        "op1_hnsw_dedup": hnsw_dedup.op1_hnsw_dedup,
        "op2_mixing": mixing.op2_mixing,
        "op3_simhash": simhash.op3_simhash,
        "op4_packing": packing.op4_packing,
        "op5_sharding": sharding.op5_sharding,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_warc": warc.op7_warc,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_topk": topk.op9_topk,
        "op10_language_id": langid.op10_language_id,
        "op11_substring_dedup": difference_cover.op11_substring_dedup,
        "op12_source_divergence": source_divergence.op12_source_divergence,
        "op13_importance_resampling": importance_resampling.op13_importance_resampling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Where DuckDB can express the query."""
    found = {"op1_hnsw_dedup": hnsw_dedup.OP1_SQL, "op2_mixing": mixing.OP2_SQL, "op7_warc": warc.OP7_SQL, "op9_topk": topk.OP9_SQL}
    found |= {"op11_substring_dedup": difference_cover.OP11_SQL, "op12_source_divergence": source_divergence.OP12_SQL, "op13_importance_resampling": importance_resampling.OP13_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
