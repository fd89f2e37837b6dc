"""Event log, read model, call log and history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..sources.tables import CALLS_SQL, META_SQL, call_logs, event_log, session_meta
from .base import query

DEFAULT_TITLE = "新对话"
CONTEXT_LIMIT, KEEP_RECENT, CUT = 20_150, 6, 200
TOKENS_SQL = "floor({c} * 1.5 + (length({t}) - {c}) / 4.0)::bigint".format(c="length(regexp_replace({t}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))", t="{t}")


def tokens_sql(text: str) -> str:
    return TOKENS_SQL.format(t=text)


def titled() -> F.Column:
    return F.coalesce(F.nullif("title", F.lit("")), F.lit(DEFAULT_TITLE)).alias("title")


@query("list_sessions_top50_per_user", f"with {META_SQL} select user_id, conv_id, coalesce(nullif(title, ''), '{DEFAULT_TITLE}') as title, rn from (select *, (row_number() over (partition by user_id order by updated_at desc, conv_id))::int as rn from meta) where rn <= 50")
def list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-03, C-01, G-01: each user's 50 latest sessions."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "conv_id"))
    return session_meta(spark, sf_dir).withColumn("rn", rn).where("rn <= 50").select("user_id", "conv_id", titled(), "rn")


@query("list_all_sessions_top100", f"with {META_SQL} select conv_id, user_id, coalesce(nullif(title, ''), '{DEFAULT_TITLE}') as title from meta order by updated_at desc, conv_id limit 100")
def list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-04: the 100 latest sessions of all users."""
    return session_meta(spark, sf_dir).orderBy(F.desc("updated_at"), "conv_id").limit(100).select("conv_id", "user_id", titled())


@query("latest_session_by_context", f"with {META_SQL} select user_id, context_key, conv_id from (select *, row_number() over (partition by user_id, context_key order by updated_at desc, conv_id desc) as rn from meta) where rn = 1")
def latest_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-02, G-03: combined before the shuffle by max_by."""
    return session_meta(spark, sf_dir).groupBy("user_id", "context_key").agg(F.max_by("conv_id", F.struct("updated_at", "conv_id")).alias("conv_id"))


def messages(log: DataFrame, conversations: list[int] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """conv_id, seq, role, content: the messages of the log, of all conversations and kinds unless some are named."""
    if conversations is not None:
        log = log.where(F.col("conv_id").isin(conversations))
    if kinds is not None:
        log = log.where(F.col("kind").isin(kinds))
    return log.select("conv_id", "seq", F.col("kind").alias("role"), "content")


@query("replay_messages", "select conv_id, turn as seq, role, text as content from conversations")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-01, C-02, G-02: the messages of every conversation."""
    return messages(event_log(spark, sf_dir))


@query("messages_user_assistant", "select conv_id, turn as seq, role, text as content from conversations where role in ('user', 'assistant')")
def user_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-02, C-04."""
    return event_log(spark, sf_dir).where(F.col("kind").isin("user", "assistant")).select("conv_id", "seq", F.col("kind").alias("role"), "content")


@query("session_with_messages", f"with {META_SQL} select m.conv_id, m.user_id, coalesce(nullif(m.title, ''), '{DEFAULT_TITLE}') as title, c.turn as seq, c.role, c.text as content from meta m join conversations c on c.conv_id = m.conv_id where m.context_key = 'O'")
def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-01, C-03: read-model rows that the caller may see, joined with their log."""
    meta = session_meta(spark, sf_dir).where("context_key = 'O'").select("conv_id", "user_id", titled())
    return meta.join(event_log(spark, sf_dir), "conv_id").select("conv_id", "user_id", "title", "seq", F.col("kind").alias("role"), "content")


@query("replay_fold", f"""with m as (select *, count(case when role <> 'system' then 1 end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as before from conversations)
select conv_id, count(case when role <> 'system' then 1 end) as n_messages, count(case when role = 'system' then 1 end) as n_compacted,
  arg_max(text, turn) filter (where role = 'user') as pending_ask, coalesce(arg_max(before, turn) filter (where role = 'system'), -1)::bigint as last_compacted_idx,
  (sum({tokens_sql("text")}) + 4 * count(*))::bigint as tokens,
  sum({tokens_sql("text")}) + 4 * count(*) > {T.compress_trigger(CONTEXT_LIMIT)} as compress from m group by conv_id""")
def replay_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-01, E-02, E-03, F-10, I-01: the state of each conversation after its last event."""
    log = event_log(spark, sf_dir)
    before = F.count(F.when(F.col("kind") != "system", 1)).over(Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    tokens = F.sum(T.estimate_tokens(F.col("content"))) + 4 * F.count(F.lit(1))
    at = lambda kind: F.when(F.col("kind") == kind, F.col("seq"))
    folded = log.withColumn("before", before).groupBy("conv_id").agg(
        F.count(F.when(F.col("kind") != "system", 1)).alias("n_messages"),
        F.count(F.when(F.col("kind") == "system", 1)).alias("n_compacted"),
        F.max_by("content", at("user")).alias("pending_ask"),
        F.coalesce(F.max_by("before", at("system")), F.lit(-1)).cast("long").alias("last_compacted_idx"),
        tokens.alias("tokens"),
    )
    return folded.withColumn("compress", F.col("tokens") > T.compress_trigger(CONTEXT_LIMIT))


@query("read_model_from_log", "select conv_id, max(turn) as updated_seq, arg_max(text, turn) filter (where role = 'assistant') as current_config, count(*) as n_events from conversations group by conv_id")
def read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-02, B-05: the read model is what the log says last, per column."""
    return event_log(spark, sf_dir).groupBy("conv_id").agg(F.max("seq").alias("updated_seq"), F.max_by("content", F.when(F.col("kind") == "assistant", F.col("seq"))).alias("current_config"), F.count(F.lit(1)).alias("n_events"))


@query("delete_cascade", f"with {META_SQL}, gone as (select conv_id from meta where context_key = 'F' and conv_id % 3 = 0) select conv_id, turn as seq, role from conversations where conv_id not in (select conv_id from gone)")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-08: tombstones of sessions that the caller owns take their events with them."""
    gone = session_meta(spark, sf_dir).where("context_key = 'F' and conv_id % 3 = 0").select("conv_id")
    return event_log(spark, sf_dir).join(gone, "conv_id", "left_anti").select("conv_id", "seq", F.col("kind").alias("role"))


def _calls(spark: SparkSession, sf_dir: str, *conditions: str) -> DataFrame:
    found = call_logs(spark, sf_dir)
    for c in conditions:
        found = found.where(c)
    return found.orderBy(F.desc("created_at"), "id").limit(100).select("id", "conv_id", "call_type", "duration")


for _name, _conditions in {"none": (), "conv": ("conv_id = 7",), "type": ("call_type = 'error'",), "both": ("conv_id = 7", "call_type = 'error'")}.items():
    _where = f"where {' and '.join(_conditions)}" if _conditions else ""
    query(f"call_logs_filtered_{_name}", f"with {CALLS_SQL} select id, conv_id, call_type, duration from calls {_where} order by created_at desc, id limit 100")(lambda s, d, c=_conditions: _calls(s, d, *c))


def exact_quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], cuts: int = 200) -> DataFrame:
    """(group, n, one column per share): quantiles with linear interpolation, exact, without holding a group's values anywhere.

    Approximate quantiles cut each group's values into `cuts` intervals, whatever their error; exact counts of the intervals
    say which ones hold the wanted ranks, and only in those the values are ranked, each distinct value once. Rows without
    a value count for n only."""
    held = rows.select(group, F.col(value).cast("double").alias("v"))
    tallies = held.where("v is not null").groupBy(group, "v").agg(F.count(F.lit(1)).alias("c"))
    edges = held.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("m"), F.percentile_approx("v", [k / cuts for k in range(1, cuts)], 1000).alias("edges"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("m") - 1)).alias("at")) for name, q in shares.items()])
    groups = edges.withColumn("ranks", ranks)  # one row per group
    slot = F.size(F.filter("edges", lambda e: e < F.col("v")))
    slotted = tallies.join(groups.select(group, "edges"), group).select(group, "v", "c", slot.alias("slot"))
    sizes = slotted.groupBy(group, "slot").agg(F.sum("c").alias("size"))
    before = F.sum("size").over(Window.partitionBy(group).orderBy("slot")) - F.col("size")
    wanted = sizes.withColumn("before", before).join(groups.select(group, "ranks"), group)
    inside = F.exists("ranks", lambda r: (F.ceil(r["at"]) >= F.col("before")) & (F.floor(r["at"]) < F.col("before") + F.col("size")))
    found = slotted.join(wanted.where(inside), [group, "slot"])
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(group, "slot").orderBy("v"))
    each = found.withColumn("upto", upto).withColumn("low", F.col("upto") - F.col("c")).withColumn("r", F.explode("ranks"))
    holds = lambda k: (k >= F.col("low")) & (k < F.col("upto"))
    near = each.select(group, "r.name", "r.at", F.when(holds(F.floor("r.at")), F.col("v")).alias("lower"), F.when(holds(F.ceil("r.at")), F.col("v")).alias("upper"))
    ends = near.groupBy(group, "name", "at").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    value_at = F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("at") - F.floor("at"))
    values = ends.groupBy(group).agg(*[F.max(F.when(F.col("name") == name, value_at)).alias(name) for name in shares])
    return groups.select(group, "n").join(values, group, "left")


@query("call_latency", f"with {CALLS_SQL} select call_type, count(*) as n, quantile_cont(duration, 0.5) as p50, quantile_cont(duration, 0.95) as p95 from calls group by call_type")
def call_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-01."""
    return exact_quantiles(call_logs(spark, sf_dir), "call_type", "duration", {"p50": 0.5, "p95": 0.95})


@query("error_rate", f"with {CALLS_SQL} select conv_id % 10 as grp, count(*) filter (where call_type = 'error') / count(*)::double as rate from calls group by 1")
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-02."""
    return call_logs(spark, sf_dir).groupBy((F.col("conv_id") % 10).alias("grp")).agg((F.count_if(F.col("call_type") == "error") / F.count(F.lit(1))).alias("rate"))


@query("calls_per_session", f"with {CALLS_SQL} select conv_id, count(*) as n_calls from calls group by conv_id")
def calls_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-03."""
    return call_logs(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_calls"))


def _recent() -> F.Column:
    return F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("seq")))


@query("keep_recent", f"select conv_id, turn as seq, role, substr(text, 1, {CUT}) as content from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn <= {KEEP_RECENT}")
def keep_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-01, F-02, I-09: the last messages, cut."""
    return event_log(spark, sf_dir).withColumn("rn", _recent()).where(F.col("rn") <= KEEP_RECENT).select("conv_id", "seq", F.col("kind").alias("role"), F.substring("content", 1, CUT).alias("content"))


@query("old_history", f"select conv_id, turn as seq from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn > {KEEP_RECENT}")
def old_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-03."""
    return event_log(spark, sf_dir).select("conv_id", "seq").withColumn("rn", _recent()).where(F.col("rn") > KEEP_RECENT).select("conv_id", "seq")


@query("compressed_history_text", f"select conv_id, string_agg(role || ': ' || substr(text, 1, {CUT}), chr(10) order by turn) as history from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn <= {KEEP_RECENT} group by conv_id")
def compressed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-15: at most KEEP_RECENT messages are gathered per conversation, the window cuts first."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat("role", F.lit(": "), "content").alias("line")))), lambda x: x["line"])
    return keep_recent(spark, sf_dir).groupBy("conv_id").agg(F.array_join(lines, "\n").alias("history"))


@query("version_history", "select conv_id, turn as version, lag(text) over (partition by conv_id order by turn) as baseline, text = last_value(text) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) as is_current from conversations where role = 'assistant'")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-06, F-07: each saved version with the one before it."""
    w = Window.partitionBy("conv_id").orderBy("seq")
    last = F.last("content").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return event_log(spark, sf_dir).where("kind = 'assistant'").select("conv_id", F.col("seq").alias("version"), F.lag("content").over(w).alias("baseline"), (F.col("content") == last).alias("is_current"))


@query("rewind_to_version", "with v as (select conv_id, text, row_number() over (partition by conv_id order by turn) as k from conversations where role = 'assistant') select conv_id, max(k) + 1 as version, max(case when k = 1 then text end) as content from v group by conv_id")
def rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-08: the first version again, as a new one."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq"))
    return event_log(spark, sf_dir).where("kind = 'assistant'").withColumn("k", k).groupBy("conv_id").agg((F.max("k") + 1).cast("long").alias("version"), F.max(F.when(F.col("k") == 1, F.col("content"))).alias("content"))


@query("pending_clarification", "select conv_id, arg_max(role, turn) = 'assistant' and arg_max(text, turn) like '%?%' as pending from conversations group by conv_id")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-05: whether the last row is an assistant's question."""
    last = F.max_by(F.struct("kind", "content"), "seq")
    return event_log(spark, sf_dir).groupBy("conv_id").agg(last.alias("last")).select("conv_id", ((F.col("last.kind") == "assistant") & F.col("last.content").contains("?")).alias("pending"))
