"""Queries over what was written: batches of the log read back from the store, sessions of several schema versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import batches as B, log_store as L, migrations as M
from ..sources.stored import shared_dir
from ..sources.tables import META_SQL, call_logs, event_log, session_meta
from .base import query


@query("stored_log", """with m as (select conv_id, count(*) + 1 as events, arg_max(text, turn) as last_content, max(turn) as last_seq from conversations group by conv_id),
c as (select user_id as conv_id, count(*) as calls, sum(round(value * 100)::bigint)::bigint as hundredths from events group by user_id)
select coalesce(m.conv_id, c.conv_id) as conv_id, coalesce(events, 0) as events, last_content, last_seq, coalesce(calls, 0) as calls, coalesce(hundredths, 0) as hundredths, case when m.conv_id is not null then 'opened' end as title
from m full outer join c on m.conv_id = c.conv_id""")
def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-01, B-04, B-09, A-01: sessions and their first events in one batch, messages with what they touch in a second, which runs
    twice, calls in a third; then everything is read back from the store."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    log = event_log(spark, sf_dir)
    opened = log.select("conv_id").distinct().select("conv_id", (F.col("conv_id") * 10).alias("user_id"), F.lit("new").alias("context_key"), F.lit("opened").alias("title"), F.timestamp_seconds(F.lit(0)).alias("created_at"))
    first, sessions = L.created(opened)
    B.commit(spark, path, 1, events=first, changes=sessions)
    messages = L.message_events(log.select("conv_id", "seq", F.col("kind").alias("role"), "content", F.lit(None).cast("string").alias("config_snapshot"), F.timestamp_seconds("seq").alias("created_at")))
    for _ in range(2):
        B.commit(spark, path, 2, events=messages, changes=L.touched_by(messages))
    calls = call_logs(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "conv_id", "call_type", "duration", "request", F.lit(None).cast("string").alias("response"), "created_at")
    B.commit(spark, path, 3, calls=calls)
    spoken = F.when(F.col("kind") != "checkpoint", F.struct("seq", F.get_json_object("payload", "$.content").alias("content")))
    told = B.table(spark, path, "events").groupBy("conv_id").agg(F.count(F.lit(1)).alias("events"), F.max_by(spoken, F.col("seq")).alias("last"))
    model = L.read_model(B.table(spark, path, "changes")).select("conv_id", "title")
    called = B.table(spark, path, "calls").groupBy("conv_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.round(F.col("duration") * 100).cast("long")).alias("hundredths"))
    both = told.join(model, "conv_id").join(called, "conv_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("conv_id", zero(F.col("events")).alias("events"), F.col("last.content").alias("last_content"), F.col("last.seq").alias("last_seq"), zero(F.col("calls")).alias("calls"), zero(F.col("hundredths")).alias("hundredths"), "title")


@query("session_versions", f"with {META_SQL} select conv_id, user_id::varchar as user_id, context_key, title, case when context_key in ('F', 'O') then '' else 's' || conv_id end as summary, case context_key when 'F' then 1 when 'O' then 2 else 3 end as version from meta")
def session_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-11, B-12: sessions written under three schemas (an older name and type of a column, columns that came later), read as one table."""
    path = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    meta = session_meta(spark, sf_dir)
    first = meta.where("context_key = 'F'").withColumnRenamed("context_key", "form_code").drop("updated_at")
    second = meta.where("context_key = 'O'").withColumn("user_id", F.col("user_id").cast("string")).drop("updated_at")
    third = meta.where("context_key not in ('F', 'O')").select("conv_id", F.col("user_id").cast("string").alias("user_id"), "context_key", "title", F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("summary"), F.lit(None).cast("string").alias("current_config"))
    for version, rows in enumerate((first, second, third), 1):
        rows.write.parquet(f"{path}/version={version}")
    return M.read(spark, path, M.SESSION_STEPS, ["conv_id", "user_id", "context_key", "title", "summary"])
