"""Routing, allow-lists and result dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..sources.tables import CALLS_SQL, call_logs, event_log, session_meta, table
from .base import query

# Headers that are passed on begin so, unless they are one of these.
ALLOWED_PREFIXES = ("x-", "authorization", "cookie", "tenant", "enterprise", "accept-language")
DENIED = ("host", "content-length", "content-type", "connection", "x-user-id", "x-accel-buffering")


@query("header_forwarding", "select event_id, array_to_string(list_sort(list_filter(['Authorization', 'HOST', case when event_type in ('click', 'view') then 'X-Kind' else 'Cookie' end, case when event_id % 2 = 0 then 'X-User-Id' else 'Enterprise-Id' end, 'X-ACCEL-Buffering', 'Accept'], lambda h: h in ('Authorization', 'X-Kind', 'Cookie', 'Enterprise-Id'))), ',') as forwarded from events")
def header_forwarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-06, I-16: the headers with an allowed prefix that are not denied, whatever their case; names are kept as they are."""
    kind = F.when(F.col("event_type").isin("click", "view"), "X-Kind").otherwise("Cookie")
    other = F.when(F.col("event_id") % 2 == 0, "X-User-Id").otherwise("Enterprise-Id")
    names = [F.lit("Authorization"), F.lit("HOST"), kind, other, F.lit("X-ACCEL-Buffering"), F.lit("Accept")]
    headers = F.map_from_arrays(F.array(*names), F.array(*[F.lit(str(k)) for k in range(len(names))]))
    kept = F.map_filter(headers, lambda k, v: F.exists(F.array(*map(F.lit, ALLOWED_PREFIXES)), lambda p: F.startswith(F.lower(k), p)) & ~F.lower(k).isin(*DENIED))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("forwarded"))


@query("whitelist_intersection", """with l as (select c_custkey as id, list(o_orderpriority) filter (where o_orderstatus = 'O') as a, list(o_orderpriority) filter (where o_orderstatus = 'F') as b from customer left join orders on o_custkey = c_custkey group by c_custkey)
select id, array_to_string(list_sort(list_distinct(case when a is null then b when b is null then a else list_intersect(a, b) end)), ',') as allowed from l""")
def whitelist_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-01, A-23, I-15: two optional lists, written with commas, blanks and gaps; a missing one sets no limit. A customer's lists are
    the priorities of their open and of their filled orders."""
    of = lambda s: F.collect_list(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(*[F.nullif(F.array_join(of(s), " ,, "), F.lit("")).alias(s) for s in "OF"])
    a, b = T.csv_list(F.col("O")), T.csv_list(F.col("F"))
    both = F.when(a.isNotNull() & b.isNotNull(), F.array_intersect(a, b)).otherwise(F.array_distinct(F.coalesce(a, b)))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return customers.join(lists, "id", "left").select("id", F.array_join(F.array_sort(both), ",").alias("allowed"))


@query("service_resolution", f"with {CALLS_SQL}, dim(call_type, base) as (values ('click', 'http://a/'), ('view', 'http://b')) select id, case when call_type in ('click', 'error') then coalesce(rtrim(base, '/'), 'http://default') else 'http://default' end as base from calls left join dim using (call_type)")
def service_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-13, I-14: base URL of a service on the allow-list, else the default."""
    dim = spark.createDataFrame([("click", "http://a/"), ("view", "http://b")], "call_type string, base string")
    joined = call_logs(spark, sf_dir).join(F.broadcast(dim), "call_type", "left")  # two rows
    base = F.when(F.col("call_type").isin("click", "error"), F.coalesce(F.rtrim("base", F.lit("/")), F.lit("http://default"))).otherwise("http://default")
    return joined.select("id", base.alias("base"))


@query("route_candidates", "select o_orderkey as id, case when o_totalprice < 50000 then 'chat,create' else 'chat,create,modify' end as candidates, case when o_orderpriority = '1-URGENT' and o_totalprice >= 50000 then 'modify' when o_orderpriority = '2-HIGH' then 'create' else 'chat' end as tool from orders")
def route_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-02, M-03, M-04: an empty canvas offers no modify; a choice that is not offered falls back to chat."""
    offered = F.filter(F.array(F.lit("chat"), F.lit("create"), F.lit("modify")), lambda t: (t != "modify") | (F.col("o_totalprice") >= 50000))
    chosen = F.when(F.col("o_orderpriority") == "1-URGENT", "modify").when(F.col("o_orderpriority") == "2-HIGH", "create")
    tool = F.when(F.array_contains(F.col("offered"), F.col("chosen")), F.col("chosen")).otherwise("chat")
    o = table(spark, sf_dir, "orders").withColumn("offered", offered).withColumn("chosen", chosen)
    return o.select(F.col("o_orderkey").alias("id"), F.array_join("offered", ",").alias("candidates"), tool.alias("tool"))


@query("result_dispatch", "select event_id, case when event_type = 'error' then 'error' when event_id % 3 = 0 then 'reply' when json_extract(props, '$.k') is not null and event_id % 3 = 1 then 'data' when event_id % 3 = 2 and event_id % 2 = 0 then 'config' else 'none' end as kind from events")
def result_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-04, N-05, N-19: error before reply before artifact, data before config."""
    third = F.col("event_id") % 3
    data = (third == 1) & F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").isNotNull()
    kind = F.when(F.col("event_type") == "error", "error").when(third == 0, "reply").when(data, "data").when((third == 2) & (F.col("event_id") % 2 == 0), "config").otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"))


@query("clarify_missing", "select o_orderkey as id, concat_ws(',', case when o_orderstatus = 'P' then 'type' end, case when o_orderkey % 5 = 0 then 'start' end, case when o_orderkey % 7 = 0 then 'end' end) as ask from orders")
def clarify_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-31: what has to be asked for."""
    gaps = F.array(F.when(F.col("o_orderstatus") == "P", "type"), F.when(F.col("o_orderkey") % 5 == 0, "start"), F.when(F.col("o_orderkey") % 7 == 0, "end"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.array_compact(gaps), ",").alias("ask"))


@query("turn_save", "select conv_id, turn as seq, unnest(case role when 'user' then ['user'] when 'assistant' then ['assistant', 'checkpoint'] else ['checkpoint'] end) as kind from conversations")
def turn_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-13, B-14: the events that one turn appends; parts that are missing give none."""
    parts = F.array(F.when(F.col("kind") == "user", "user"), F.when(F.col("kind") == "assistant", "assistant"), F.when(F.col("kind") != "user", "checkpoint"))
    return event_log(spark, sf_dir).select("conv_id", "seq", F.explode(F.array_compact(parts)).alias("kind"))


@query("prompt_assemble", "select o_orderkey as id, case when o_orderstatus = 'P' then 'override' else array_to_string(list_filter(['main', case when o_orderkey % 2 = 0 then o_orderpriority else ' ' end, 'tail'], lambda x: trim(x) <> ''), chr(10) || chr(10)) end as prompt from orders")
def prompt_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-11, C-15: an override wins, blank sections go."""
    sections = F.filter(F.array(F.lit("main"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(" "), F.lit("tail")), lambda s: F.trim(s) != "")
    prompt = F.coalesce(F.when(F.col("o_orderstatus") == "P", "override"), F.array_join(sections, "\n\n"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), prompt.alias("prompt"))


@query("owner_filter", "select o_orderkey as conv_id from orders where o_custkey = 7 or o_orderstatus = 'P'")
def owner_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-03, C-09: the rows of a user, and those an administrator sees."""
    return session_meta(spark, sf_dir).where((F.col("user_id") == 7) | (F.col("context_key") == "P")).select("conv_id")
