"""An append-only store of the event log, the call log and the changes of sessions, as Parquet folders.

Nothing is updated in place: a change of a session is a row that names what changed (nulls: not changed), and the read model is
the fold of its rows. Every write is one append, so one that fails or runs again leaves the rows before it as they were; a
reader that must not see a batch twice keys rows by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVENTS = "id string, conv_id long, seq long, kind string, payload string, created_at timestamp"
CHANGES = "conv_id long, at timestamp, id string, user_id long, context_key string, title string, current_config string"
CALLS = "id string, conv_id long, call_type string, duration double, request string, response string, created_at timestamp"
_BLANK = {"user_id": "long", "context_key": "string", "title": "string", "current_config": "string"}


def message_payload(role: Column, content: Column, snapshot: Column | None = None) -> Column:
    """A message's payload as JSON text; the snapshot of a configuration is null unless there is one."""
    return F.to_json(F.struct(role.alias("role"), content.alias("content"), (snapshot if snapshot is not None else F.lit(None).cast("string")).alias("config_snapshot")), {"ignoreNullFields": "false"})


def message_events(messages: DataFrame) -> DataFrame:
    """B-03: events of messages (conv_id, seq, role, content, config_snapshot, created_at): kind user or, for any other role,
    assistant. An id is a hash of the row, so that a batch that runs again names its rows alike."""
    kind = F.when(F.col("role") == "user", "user").otherwise("assistant")
    key = F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("seq").cast("string"), "role", F.coalesce("config_snapshot", F.lit(""))), 256)
    return messages.select(key.alias("id"), "conv_id", "seq", kind.alias("kind"), message_payload(F.col("role"), F.col("content"), F.col("config_snapshot")).alias("payload"), "created_at")


def changes(rows: DataFrame, **set_: Column) -> DataFrame:
    """Change rows of sessions from rows with conv_id, at, id: the named columns are set, all others are left."""
    return rows.select("conv_id", "at", "id", *[(set_[c] if c in set_ else F.lit(None)).cast(t).alias(c) for c, t in _BLANK.items()])


def touched_by(events: DataFrame) -> DataFrame:
    """B-02, B-07: the change rows that events bring: their session was active."""
    return changes(events.select("conv_id", F.col("created_at").alias("at"), "id"))


def created(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B-04: (events, changes) of new sessions (conv_id, user_id, context_key, title, created_at): a checkpoint opens the log."""
    key = F.concat(F.lit("new-"), F.col("conv_id").cast("string"))
    events = sessions.select(key.alias("id"), "conv_id", F.lit(0).cast("long").alias("seq"), F.lit("checkpoint").alias("kind"), F.to_json(F.struct(F.lit("created").alias("action"))).alias("payload"), "created_at")
    rows = sessions.select("conv_id", F.col("created_at").alias("at"), key.alias("id"), "user_id", "context_key", "title")
    return events, changes(rows, user_id=F.col("user_id"), context_key=F.col("context_key"), title=F.col("title"))


def configured(rows: DataFrame) -> DataFrame:
    """B-05: change rows of new configurations (conv_id, at, id, config, title); an empty title leaves the one that is there."""
    return changes(rows, current_config=F.col("config"), title=F.nullif("title", F.lit("")))


def read_model(rows: DataFrame) -> DataFrame:
    """The sessions as their change rows leave them: of each column the last value that was set, and when there was any change."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "id"))).alias(c)
    return rows.groupBy("conv_id").agg(*map(last, _BLANK), F.max("at").alias("updated_at"))


def append(spark: SparkSession, path: str, events: DataFrame | None = None, meta: DataFrame | None = None, calls: DataFrame | None = None) -> None:
    """B-01, B-09: append rows to the tables of the store, the log first: a reader then never sees a session without its event."""
    for name, rows, schema in (("events", events, EVENTS), ("changes", meta, CHANGES), ("calls", calls, CALLS)):
        if rows is not None:
            columns = [c.split() for c in schema.split(", ")]
            rows.select(*[F.col(c).cast(t).alias(c) for c, t in columns]).write.mode("append").parquet(f"{path}/{name}")
