"""What turns and sessions write to the log, and the read model that follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..sources import log_store as L
from ..sources.tables import event_log
from .base import query
from .conversations import CONTEXT_LIMIT, KEEP_RECENT, tokens_sql

_MESSAGES_SQL = "m as (select conv_id, turn as seq, role, text, case when role = 'assistant' and turn % 2 = 1 then 'cfg' || turn end as snap from conversations)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the log as they would be added: odd answers carry a snapshot; time is that of the turn."""
    snapshot = F.when((F.col("kind") == "assistant") & (F.col("seq") % 2 == 1), F.concat(F.lit("cfg"), F.col("seq").cast("string")))
    return event_log(spark, sf_dir).select("conv_id", "seq", F.col("kind").alias("role"), "content", snapshot.alias("config_snapshot"), F.timestamp_seconds("seq").alias("created_at"))


@query("message_events", f"with {_MESSAGES_SQL} select conv_id, seq, case when role = 'user' then 'user' else 'assistant' end as kind, role, text as content, snap as snapshot from m")
def message_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-01, B-03: messages become events; the payload gives them back."""
    at = lambda p: F.get_json_object("payload", f"$.{p}")
    return L.message_events(_messages(spark, sf_dir)).select("conv_id", "seq", "kind", at("role").alias("role"), at("content").alias("content"), at("config_snapshot").alias("snapshot"))


@query("session_changes_fold", f"""with {_MESSAGES_SQL} select conv_id, min(conv_id) * 10 as user_id, coalesce(arg_max('ctx' || seq, seq) filter (where role = 'system'), 'new') as context_key,
  coalesce(arg_max('t' || seq, seq) filter (where snap is not null and seq % 4 = 1), 'opened') as title, arg_max(snap, seq) filter (where snap is not null) as current_config, max(seq)::bigint as updated_seq from m group by conv_id""")
def session_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-02, B-04 to B-07: sessions are created, every message touches them, system rows set the context key, snapshots set the
    configuration and, if they bring a title, that; the read model is the fold of these rows."""
    messages = _messages(spark, sf_dir)
    events = L.message_events(messages)
    opened = messages.groupBy("conv_id").agg(F.min("created_at").alias("created_at")).select("conv_id", (F.col("conv_id") * 10).alias("user_id"), F.lit("new").alias("context_key"), F.lit("opened").alias("title"), (F.col("created_at") - F.expr("interval 1 second")).alias("created_at"))
    rows = messages.select("conv_id", F.col("created_at").alias("at"), F.col("seq").cast("string").alias("id"), "role", "config_snapshot", "seq")
    context = L.changes(rows.where("role = 'system'"), context_key=F.concat(F.lit("ctx"), F.col("seq").cast("string")))
    title = F.when(F.col("seq") % 4 == 1, F.concat(F.lit("t"), F.col("seq").cast("string"))).otherwise("")
    config = L.configured(rows.where("config_snapshot is not null").select("conv_id", "at", "id", F.col("config_snapshot").alias("config"), title.alias("title")))
    every = L.created(opened)[1].unionByName(L.touched_by(events)).unionByName(context).unionByName(config)
    return L.read_model(every).select("conv_id", "user_id", "context_key", "title", "current_config", F.unix_seconds("updated_at").alias("updated_seq"))


_TURNS_SQL = "t as (select u.conv_id, u.turn as seq, u.text as input, case when u.turn % 3 = 0 then '' else a.text end as reply, 's' || u.turn as summary, case when u.turn % 2 = 0 then 'art' || u.turn end as artifact from conversations u left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' where u.role = 'user')"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns: what a user said, what came back (some have no reply, only a summary; some bring an artifact)."""
    log = event_log(spark, sf_dir)
    answer = log.where("kind = 'assistant'").select("conv_id", (F.col("seq") - 1).alias("seq"), F.col("content").alias("said"))
    asked = log.where("kind = 'user'").select("conv_id", "seq", F.col("content").alias("input")).join(answer, ["conv_id", "seq"], "left")
    n = F.col("seq").cast("string")
    return asked.select("conv_id", "seq", "input", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("said")).alias("reply"), F.concat(F.lit("s"), n).alias("summary"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("art"), n)).alias("artifact"))


@query("turn_events", f"""with {_TURNS_SQL} select conv_id, seq, i, kind, content from (
  select conv_id, seq, 1 as i, 'user' as kind, input as content from t union all select conv_id, seq, 2, 'assistant', coalesce(nullif(reply, ''), summary) from t union all select conv_id, seq, 3, 'checkpoint', artifact from t where artifact is not null)""")
def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-13: a turn's events in one batch: the input; the reply, or else the summary; the artifact as a checkpoint."""
    answer = F.coalesce(F.nullif("reply", F.lit("")), F.nullif("summary", F.lit("")))
    part = lambda i, kind, content: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), content.alias("content"))
    parts = F.filter(F.array(part(1, "user", F.col("input")), part(2, "assistant", answer), part(3, "checkpoint", F.col("artifact"))), lambda p: p["content"].isNotNull())
    return _turns(spark, sf_dir).select("conv_id", "seq", F.explode(parts).alias("p")).select("conv_id", "seq", "p.i", "p.kind", "p.content")


@query("turn_messages", f"""with {_TURNS_SQL} select conv_id, seq, i, role, content, snapshot from (
  select conv_id, seq, 1 as i, 'user' as role, input as content, null as snapshot from t union all select conv_id, seq, 2, 'assistant', summary, null from t union all select conv_id, seq, 3, 'assistant', summary, artifact from t where artifact is not null)""")
def turn_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-14: the live path writes messages: input, summary, and once more the summary with the configuration, if there is one."""
    none = F.lit(None).cast("string")
    part = lambda i, role, content, snapshot: F.struct(F.lit(i).alias("i"), F.lit(role).alias("role"), F.col(content).alias("content"), snapshot.alias("config_snapshot"))
    last = F.when(F.col("artifact").isNotNull(), part(3, "assistant", "summary", F.col("artifact")))
    parts = F.array_compact(F.array(part(1, "user", "input", none), part(2, "assistant", "summary", none), last))
    rows = _turns(spark, sf_dir).select("conv_id", "seq", F.explode(parts).alias("p")).select("conv_id", "seq", "p.*", F.timestamp_seconds("seq").alias("created_at"))
    return rows.select("conv_id", "seq", "i", "role", "content", F.col("config_snapshot").alias("snapshot"))


@query("interrupt_turn", f"with {_TURNS_SQL} select conv_id, seq, 1 as i, 'user' as role, input as content from t where coalesce(reply, '') = '' union all select conv_id, seq, 2, 'assistant', '? ' || summary from t where coalesce(reply, '') = ''")
def interrupt_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-15: a turn that stops to ask (it has no reply) writes its input and the question as the answer."""
    part = lambda i, role, content: F.struct(F.lit(i).alias("i"), F.lit(role).alias("role"), content.alias("content"))
    parts = F.array(part(1, "user", F.col("input")), part(2, "assistant", F.concat(F.lit("? "), "summary")))
    return _turns(spark, sf_dir).where("coalesce(reply, '') = ''").select("conv_id", "seq", F.explode(parts).alias("p")).select("conv_id", "seq", "p.*")


@query("turn_replay_fold", f"""with {_TURNS_SQL} select conv_id, count(*) * 2 as n_messages, count(artifact) as n_checkpoints, arg_max(artifact, seq) filter (where artifact is not null) as last_artifact, arg_max(input, seq) as last_input,
  string_agg(artifact, ',' order by seq) as artifacts from t group by conv_id""")
def turn_replay_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-01 over the events that turns wrote: messages, checkpoints in order, the last artifact, the last input."""
    events = turn_events(spark, sf_dir)
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    saved = F.transform(F.array_sort(F.collect_list(of("checkpoint", F.struct("seq", "content")))), lambda x: x["content"])
    by = events.groupBy("conv_id").agg(F.count(of("user", F.lit(1))).alias("u"), F.count(of("assistant", F.lit(1))).alias("a"), F.count(of("checkpoint", F.lit(1))).alias("n_checkpoints"), F.max_by("content", of("checkpoint", F.col("seq"))).alias("last_artifact"), F.max_by("content", of("user", F.col("seq"))).alias("last_input"), saved.alias("saved"))
    return by.select("conv_id", (F.col("u") + F.col("a")).alias("n_messages"), "n_checkpoints", "last_artifact", "last_input", F.nullif(F.array_join("saved", ","), F.lit("")).alias("artifacts"))


@query("compaction_events", f"""with m as (select *, row_number() over (partition by conv_id order by turn desc) as rn, sum({tokens_sql('text')}) over (partition by conv_id) + 4 * count(*) over (partition by conv_id) as before from conversations),
c as (select conv_id, max(before)::bigint as before, count(*) filter (where rn > {KEEP_RECENT}) as n_old, max(turn) filter (where rn > {KEEP_RECENT}) as upto, (sum({tokens_sql('text')}) filter (where rn <= {KEEP_RECENT}) + 4 * count(*) filter (where rn <= {KEEP_RECENT}))::bigint as kept from m group by conv_id having max(before) > {T.compress_trigger(CONTEXT_LIMIT)} and count(*) > {KEEP_RECENT})
select conv_id, 'compacted' as kind, upto as seq, 'summary of ' || n_old as content from c union all select conv_id, 'trace', upto, before || '>' || kept from c""")
def compaction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-12: what a compression writes once its summary is there: the compacted event in place of the old part, and a trace of
    the tokens before and after. The summary itself is given from outside (here: a count)."""
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("seq")))
    log = event_log(spark, sf_dir).withColumn("old", rn > KEEP_RECENT).withColumn("t", T.estimate_tokens(F.col("content")) + 4)
    total = lambda c: F.sum(c).cast("long")
    by = log.groupBy("conv_id").agg(total("t").alias("before"), F.count_if("old").alias("n_old"), F.max(F.when(F.col("old"), F.col("seq"))).alias("seq"), total(F.when(~F.col("old"), F.col("t"))).alias("kept"))
    due = by.where((F.col("before") > T.compress_trigger(CONTEXT_LIMIT)) & (F.col("n_old") > 0))
    row = lambda kind, content: F.struct(F.lit(kind).alias("kind"), content.alias("content"))
    rows = F.array(row("compacted", F.concat(F.lit("summary of "), F.col("n_old").cast("string"))), row("trace", F.concat(F.col("before").cast("string"), F.lit(">"), F.col("kept").cast("string"))))
    return due.select("conv_id", "seq", F.explode(rows).alias("r")).select("conv_id", "r.kind", "seq", "r.content")


@query("prompt_with_append", "select conv_id, turn as seq, case when role = 'system' then text else array_to_string(list_filter([case when turn % 2 = 0 then 'section a' end, nullif(trim(text), ''), case when role = 'assistant' then 'append ' || turn end], lambda x: x is not null), chr(10) || chr(10)) end as prompt from conversations")
def prompt_with_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-11: an override wins; else the sections, the main part and what is appended, blank parts left out."""
    section, append = F.when(F.col("seq") % 2 == 0, "section a"), F.when(F.col("kind") == "assistant", F.concat(F.lit("append "), F.col("seq").cast("string")))
    parts = F.array_compact(F.array(section, F.nullif(F.trim("content"), F.lit("")), append))
    override = F.when(F.col("kind") == "system", F.col("content"))
    return event_log(spark, sf_dir).select("conv_id", "seq", F.coalesce(override, F.array_join(parts, "\n\n")).alias("prompt"))
