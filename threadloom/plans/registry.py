"""All queries of the engine's own plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversations, dispatch, documents, form_rules, log_writes, op_batches, open_docs, prompts, stateful, stored, texts, trees, values, views  # noqa: F401  they register their queries
from .base import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folded row per conversation: messages, last ask, compaction point, tokens, compress decision."""
    return conversations.replay_fold(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
