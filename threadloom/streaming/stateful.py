"""Streaming forms of the stateful operators. Each takes a streaming DataFrame and returns one; checkpoints are the caller's."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.replays import breaker_step, ttl_step


def idle_sessions(events: DataFrame, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """K-03, K-05: stretches of activity per conversation, closed by a gap. events: conv_id, ts."""
    return events.withWatermark("ts", late).groupBy("conv_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("conv_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def matched_replies(requests: DataFrame, replies: DataFrame, within: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """D-14: each request with its reply, or with nulls once the bound has passed. Both: id, ts; replies also payload."""
    q = requests.withWatermark("ts", late).select(F.col("id"), F.col("ts").alias("asked_at"))
    r = replies.withWatermark("ts", late).select(F.col("id").alias("reply_to"), F.col("ts").alias("answered_at"), "payload")
    on = F.expr(f"reply_to = id and answered_at >= asked_at and answered_at <= asked_at + interval {within}")
    return q.join(r, on, "left_outer")


def breaker(calls: DataFrame) -> DataFrame:
    """K-10: state before each call. calls: conv_id, seq, ok, ts_ms; the rule is replays.breaker_step, as in batch.

    Rows of a micro-batch are taken in order of seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, rows = state.get if state.exists else None, []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            held, out = breaker_step(held, (r.seq, r.ok, r.ts_ms))
            rows += [(key[0], *x) for x in out]
        state.update(tuple(map(int, held)))
        yield pd.DataFrame(rows, columns=["conv_id", "seq", "state"])

    return calls.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, seq long, state string", "streak int, opened long", "append", GroupStateTimeout.NoTimeout)


def cache_hits(lookups: DataFrame) -> DataFrame:
    """K-11: whether each lookup finds a live entry. lookups: key, seq, ts_ms; the rule is replays.ttl_step, as in batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, rows = state.get[0] if state.exists else None, []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            held, out = ttl_step(held, (r.seq, r.ts_ms))
            rows += [(key[0], *x) for x in out]
        state.update((int(held),))
        yield pd.DataFrame(rows, columns=["key", "seq", "hit"])

    return lookups.groupBy("key").applyInPandasWithState(step, "key string, seq long, hit boolean", "written long", "append", GroupStateTimeout.NoTimeout)


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id").agg(F.max_by(F.struct("seq", "config"), "seq").alias("s")).select("conv_id", "s.seq", "s.config")


def upsert_read_model(changes: DataFrame, path: str, checkpoint: str):
    """B-02, B-05: keep the latest row per conversation under `path`. changes: conv_id, seq, config.

    Each micro-batch adds its own latest rows and touches nothing else, so its cost follows what came in and not what is there;
    a batch that runs twice overwrites only itself. Readers fold what lies there; `compact` folds it for good now and then.
    Returns the writer; read with `read_model`."""

    def save(batch: DataFrame, number: int) -> None:
        _latest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def read_model(spark, path: str, upto: int | None = None) -> DataFrame:
    """The model after micro-batch `upto` (the last one there by default). A compacted range counts as its last batch."""
    rows = spark.read.parquet(path)
    return _latest(rows if upto is None else rows.where(F.col("batch") <= upto))


def compact(spark, path: str, target: str) -> int:
    """Write the folded model under `target` as one batch with the number of the last; that number. The caller switches over."""
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    read_model(spark, path, last).write.mode("overwrite").parquet(f"{target}/batch={last}")
    return last
