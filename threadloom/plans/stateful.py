"""Batch forms of the stateful operators, by event time; the streaming forms are in the streaming package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.replays import COOLDOWN_MS, THRESHOLD, TTL_MS, breaker_step, replayed, ttl_step
from ..sources.tables import CALLS_SQL, call_logs, table
from .base import query

IDLE_S, REPLY_S = 60, 3600
#: Seconds in which a host has to answer, by kind of request.
BOUNDS = {"INIT": 3, "GET_CONTEXT": 10, "APPLY": 30, "ANY": REPLY_S}


def _micros(time: F.Column) -> F.Column:
    return F.unix_micros(time.cast("timestamp"))


def _by_session() -> Window:
    return Window.partitionBy("conv_id").orderBy("created_at", "id")


_STREAK_SQL = f"with {CALLS_SQL}, g as (select *, sum(case when call_type <> 'error' then 1 else 0 end) over (partition by conv_id order by created_at, id) as grp from calls), r as (select *, sum(case when call_type = 'error' then 1 else 0 end) over (partition by conv_id, grp order by created_at, id) as streak from g)"


def _streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row up to each call: a running count that starts again at each success."""
    calls = call_logs(spark, sf_dir).select("id", "conv_id", "call_type", "created_at")
    grouped = calls.withColumn("grp", F.sum((F.col("call_type") != "error").cast("int")).over(_by_session()))
    running = F.sum((F.col("call_type") == "error").cast("int")).over(Window.partitionBy("conv_id", "grp").orderBy("created_at", "id"))
    return grouped.withColumn("streak", running)


@query("circuit_breaker_max_streak", f"{_STREAK_SQL} select conv_id, max(streak)::bigint as max_streak from r group by conv_id")
def max_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-10."""
    return _streaks(spark, sf_dir).groupBy("conv_id").agg(F.max("streak").alias("max_streak"))


_MS = "epoch_ms(created_at)"
_RN = f"{CALLS_SQL}, c as (select *, {_MS} as at, row_number() over (partition by {{k}} order by created_at, id) as rn from calls)"


@query("breaker_states", f"""with recursive {_RN.format(k='conv_id')}, s as (
  select conv_id, rn, id, 'closed' as state, (call_type = 'error')::int as failures, 0::bigint as opened from c where rn = 1
  union all select c.conv_id, c.rn, c.id, case when s.failures < {THRESHOLD} then 'closed' when c.at - s.opened <= {COOLDOWN_MS} then 'open' else 'half_open' end,
    case when s.failures >= {THRESHOLD} and c.at - s.opened <= {COOLDOWN_MS} then s.failures when call_type <> 'error' then 0 when s.failures >= {THRESHOLD} then 1 else s.failures + 1 end,
    case when call_type = 'error' and s.failures = {THRESHOLD} - 1 then c.at else s.opened end
  from s join c on c.conv_id = s.conv_id and c.rn = s.rn + 1)
select id, state from s""")
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-10: what each call finds: closed, open (it is not made and does not count), or half open after the cooldown."""
    calls = call_logs(spark, sf_dir).select("id", "conv_id", (F.col("call_type") != "error").alias("ok"), "created_at", F.floor(_micros(F.col("created_at")) / 1000).cast("long").alias("at"))
    return replayed(calls, ["conv_id"], ["created_at", "id"], ["id", "ok", "at"], breaker_step, "id long, state string").select("id", "state")


@query("ttl_cache_replay", f"""with recursive {_RN.format(k='conv_id, call_type')}, s as (
  select conv_id, call_type, rn, c.at as written, 0 as hit from c where rn = 1
  union all select c.conv_id, c.call_type, c.rn, case when c.at - s.written < {TTL_MS} then s.written else c.at end, (c.at - s.written < {TTL_MS})::int
  from s join c on c.conv_id = s.conv_id and c.call_type = s.call_type and c.rn = s.rn + 1)
select conv_id, call_type, count(*) as lookups, sum(hit)::bigint as hits from s group by 1, 2""")
def ttl_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-11: lookups and hits of each entry; an entry lives from when it was written, whoever looks at it."""
    lookups = call_logs(spark, sf_dir).select("id", "conv_id", "call_type", "created_at", F.floor(_micros(F.col("created_at")) / 1000).cast("long").alias("at"))
    found = replayed(lookups, ["conv_id", "call_type"], ["created_at", "id"], ["id", "at"], ttl_step, "id long, hit boolean")
    return found.groupBy("conv_id", "call_type").agg(F.count(F.lit(1)).alias("lookups"), F.count_if("hit").alias("hits"))


@query("idle_gaps", f"with {CALLS_SQL} select id, conv_id from (select *, epoch(created_at - lag(created_at) over (partition by conv_id order by created_at, id)) as gap from calls) where gap > {IDLE_S}")
def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-03, K-05: the calls that came after more than a minute of silence."""
    gap = _micros(F.col("created_at")) - _micros(F.lag("created_at").over(_by_session()))
    return call_logs(spark, sf_dir).select("id", "conv_id", "created_at").withColumn("gap", gap).where(F.col("gap") > IDLE_S * 1_000_000).select("id", "conv_id")


_ASK = f"{CALLS_SQL}, q as (select *, json_extract(request, '$.k')::bigint as k from calls)"


@query("request_response_timeout", f"""with {_ASK}, hosts(kind, seconds) as (values ('INIT', 3), ('GET_CONTEXT', 10), ('APPLY', 30), ('ANY', {REPLY_S})),
a as (select q.id, q.conv_id, q.k, q.created_at, hosts.kind, hosts.seconds from q join hosts on hosts.kind = ['INIT', 'GET_CONTEXT', 'APPLY', 'ANY'][q.id % 4 + 1] where call_type = 'click')
select a.id, a.kind, count(r.id) as replies, count(r.id) = 0 as timed_out from a left join q r
  on r.call_type = 'view' and r.conv_id = a.conv_id and r.k = a.k and r.created_at >= a.created_at and epoch_us(r.created_at) <= epoch_us(a.created_at) + a.seconds::bigint * 1000000 group by 1, 2""")
def request_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-14, K-15: replies to each request by its correlation id (session and number) within the bound of its kind.

    One sort per id and no join: a reply counts for the requests before it, by a running count looked up at both ends of the bound."""
    calls = call_logs(spark, sf_dir).where("call_type in ('click', 'view')").withColumn("k", F.get_json_object("request", "$.k").cast("long"))
    kinds = list(BOUNDS)
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % len(kinds) + 1).cast("int"))
    rows = calls.select("id", "conv_id", "k", "call_type", kind.alias("kind"), _micros(F.col("created_at")).alias("at"))
    by = Window.partitionBy("conv_id", "k").orderBy("at")
    view = F.count(F.when(F.col("call_type") == "view", 1))
    counted = rows.select("*", *[view.over(by.rangeBetween(0, s * 1_000_000)).alias(f"in_{n}") for n, s in BOUNDS.items()])
    replies = F.coalesce(*[F.when(F.col("kind") == n, F.col(f"in_{n}")) for n in kinds])
    return counted.where("call_type = 'click'").select("id", "kind", replies.alias("replies"), (replies == 0).alias("timed_out"))


@query("stage_progress", "with s as (select user_id, max(case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 else 0 end) as stage, max(event_type = 'error') as failed from events group by user_id) select user_id, stage::int as stage, case when failed then 'failed' when stage = 3 then 'done' else 'running' end as status from s")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-06, K-18: the furthest stage of each request and its status."""
    stages = {"click": 1, "view": 2, "purchase": 3}
    stage = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in stages.items() for x in kv]), F.col("event_type")), F.lit(0))
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(stage).alias("stage"), F.bool_or(F.col("event_type") == "error").alias("failed"))
    return by.select("user_id", "stage", F.when(F.col("failed"), "failed").when(F.col("stage") == 3, "done").otherwise("running").alias("status"))


_STEPS = "['generate', 'validate', 'apply']"


@query("pipeline_steps", f"""with cur as (select event_id, ['generate', 'generate_retry', 'generate_done', 'validate_pass', 'validate_fail', 'apply', 'other', null][event_id % 8 + 1] as stage from events),
here as (select *, list_position(list_transform({_STEPS}, lambda x: starts_with(stage, x)), true) as i from cur)
select event_id, array_to_string(list_transform([1, 2, 3], lambda k: case when i > k then 'done' when i = k then case when regexp_matches(stage, '(_done|_pass|_fail)$') then 'done' else 'active' end else 'pending' end), ',') as status from here""")
def pipeline_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-06: the steps of a pipeline by the stage that was told last: the first step whose key it begins with is running, or done
    if the stage ends so; the ones before it are done."""
    stages = F.array(*map(F.lit, ("generate", "generate_retry", "generate_done", "validate_pass", "validate_fail", "apply", "other", None)))
    steps = F.array(*map(F.lit, ("generate", "validate", "apply")))
    told = table(spark, sf_dir, "events").select("event_id", F.element_at(stages, (F.col("event_id") % 8 + 1).cast("int")).alias("stage"))
    at = told.withColumn("i", F.array_position(F.transform(steps, lambda x: F.coalesce(F.startswith("stage", x), F.lit(False))), True))
    status = lambda x, k: F.when(F.col("i") > k + 1, "done").when(F.col("i") != k + 1, "pending").when(F.col("stage").rlike("(_done|_pass|_fail)$"), "done").otherwise("active")
    return at.select("event_id", F.array_join(F.transform(steps, status), ",").alias("status"))


@query("revision_conflict", f"with {CALLS_SQL} select id, rev - 1 as current_revision, (case when id % 4 = 0 then rev - 2 else rev - 1 end) <> rev - 1 as conflict from (select *, row_number() over (partition by conv_id order by created_at, id) as rev from calls)")
def revision_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-17: a write whose base revision is not the current one conflicts; every fourth write has a stale base."""
    rev = F.row_number().over(_by_session()).cast("long")
    base = F.when(F.col("id") % 4 == 0, F.col("rev") - 2).otherwise(F.col("rev") - 1)
    return call_logs(spark, sf_dir).select("id", "conv_id", "created_at").withColumn("rev", rev).select("id", (F.col("rev") - 1).alias("current_revision"), (base != F.col("rev") - 1).alias("conflict"))
