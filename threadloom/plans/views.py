"""What is shown or told of sessions, forms, packs and calls: projections and small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.tables import BASE_SQL, CALLS_SQL, FIELDS_SQL, call_logs, event_log, first_of_each_key, form_fields, table
from .base import query

# Titles of results that have no name, names shown, hidden keys of a leave record.
TITLES = {"create": "新对话", "get": "表单查询", "clone": "表单复制", "image": "表单查询"}
SHOWN, DESCRIBED = 10, 15
HIDDEN = ("status", "approvalId")

_TOOL = "['create', 'get', 'clone', 'image'][form_id % 4 + 1]"


@query("tool_result_views", f"""with {FIELDS_SQL}, f as (select form_id, {_TOOL} as tool, count(*) as n, string_agg(case when pos <= {SHOWN} then 'f' || field_key end, ', ' order by pos) as names from fields group by form_id)
select form_id, tool, n as field_count, case when form_id % 3 = 0 then case tool when 'create' then '新对话' when 'clone' then '表单复制' else '表单查询' end else 'form' || form_id end as title,
  case tool when 'clone' then '复制的表单: ' when 'create' then '当前表单: ' else '查询的表单: ' end || case when form_id % 3 = 0 then '' else 'form' || form_id end || ' (c' || form_id || ')' ||
  case when tool = 'clone' then ', ' || n || ' 个字段' else ', 字段: ' || names || case when n > {SHOWN} then ' ... 共 ' || n || ' 个字段' else '' end end as summary from f""")
def tool_result_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-12, E-10: field count, title and one-line summary of the forms that each tool brings; copies tell only their count."""
    tool = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("form_id") % len(TITLES) + 1).cast("int"))
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "field_key"))), 1, SHOWN), lambda x: F.concat(F.lit("f"), x["field_key"].cast("string")))
    by = form_fields(spark, sf_dir).groupBy("form_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(names, ", ").alias("names")).withColumn("tool", tool)
    name = F.when(F.col("form_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("form"), F.col("form_id").cast("string")))
    titles = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    opening = F.when(F.col("tool") == "clone", "复制的表单: ").when(F.col("tool") == "create", "当前表单: ").otherwise("查询的表单: ")
    n = F.col("n").cast("string")
    tail = F.when(F.col("tool") == "clone", F.concat(F.lit(", "), n, F.lit(" 个字段"))).otherwise(F.concat(F.lit(", 字段: "), "names", F.when(F.col("n") > SHOWN, F.concat(F.lit(" ... 共 "), n, F.lit(" 个字段"))).otherwise("")))
    return by.select("form_id", "tool", F.col("n").alias("field_count"), F.coalesce(F.nullif(name, F.lit("")), F.element_at(titles, F.col("tool"))).alias("title"), F.concat(opening, name, F.lit(" (c"), F.col("form_id").cast("string"), F.lit(")"), tail).alias("summary"))


@query("current_form_description", f"""with {FIELDS_SQL} select form_id, '当前表单「' || case when form_id % 3 = 0 then 'c' || form_id else 'form' || form_id end || '」（c' || form_id || '），共 ' || count(*) || ' 个字段：' ||
  string_agg(case when pos <= {DESCRIBED} then case when type_code = 1 then 'k' || field_key else '题' || pos end end, '、' order by pos) || case when count(*) > {DESCRIBED} then ' 等 ' || count(*) || ' 个字段' else '' end as description from fields group by form_id""")
def current_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-11: the form on the page in one sentence, its first fifteen fields by title, else by key."""
    title = F.when(F.col("type_code") != 1, F.concat(F.lit("题"), F.col("pos").cast("string"))).otherwise(F.concat(F.lit("k"), F.col("field_key").cast("string")))
    listed = F.slice(F.array_sort(F.collect_list(F.struct("pos", title.alias("t")))), 1, DESCRIBED)
    by = form_fields(spark, sf_dir).groupBy("form_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(listed, lambda x: x["t"]), "、").alias("names"))
    code, n = F.concat(F.lit("c"), F.col("form_id").cast("string")), F.col("n").cast("string")
    name = F.when(F.col("form_id") % 3 == 0, code).otherwise(F.concat(F.lit("form"), F.col("form_id").cast("string")))
    more = F.when(F.col("n") > DESCRIBED, F.concat(F.lit(" 等 "), n, F.lit(" 个字段"))).otherwise("")
    return by.select("form_id", F.concat(F.lit("当前表单「"), name, F.lit("」（"), code, F.lit("），共 "), n, F.lit(" 个字段："), "names", more).alias("description"))


@query("leave_record_view", f"""select o_orderkey as id, '请假申请 - ' || case when o_orderstatus = 'P' then '' else 'u' || o_custkey end as title,
  1 + (o_orderpriority <> '4-NOT SPECIFIED')::int + (o_totalprice > 100000)::int + (o_totalprice > 200000)::int as field_count from orders""")
def leave_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-14: a leave record's title and how many of its keys are not internal; what a record lacks is not there."""
    price = F.col("o_totalprice")
    person = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("u"), F.col("o_custkey").cast("string")))
    parts = {"applicant": person, "leaveType": F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")), "status": F.when(price > 50000, "draft"), "approvalId": F.when(F.col("o_orderstatus") == "F", "7"), "reason": F.when(price > 100000, "rest"), "days": F.when(price > 200000, "3")}
    record = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*parts.values())), lambda k, v: v.isNotNull())
    shown = F.map_filter("record", lambda k, v: ~k.isin(*HIDDEN))
    return table(spark, sf_dir, "orders").withColumn("record", record).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("请假申请 - "), F.element_at("record", F.lit("applicant"))).alias("title"), F.size(shown).alias("field_count"))


@query("latest_formatted", "select conv_id, arg_max(text, turn) filter (where role = 'assistant' and turn % 2 = 1) as formatted, max(turn) filter (where role = 'assistant' and turn % 2 = 1) as at from conversations group by conv_id")
def latest_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-04: the last message of a conversation that carries formatted data (here: the odd answers), scanning backwards; else null."""
    has = (F.col("kind") == "assistant") & (F.col("seq") % 2 == 1)
    seq = F.when(has, F.col("seq"))
    return event_log(spark, sf_dir).groupBy("conv_id").agg(F.max_by("content", seq).alias("formatted"), F.max(seq).alias("at"))


@query("prompt_sizes", "select conv_id, sum(coalesce(length(text), 0))::bigint as chars, sum(length(to_json({'role': role, 'content': text})))::bigint as json_chars from conversations group by conv_id")
def prompt_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-12, I-35: characters of a prompt's messages, and of the messages as JSON."""
    size = F.length(F.to_json(F.struct(F.col("kind").alias("role"), "content"), {"ignoreNullFields": "false"}))
    return event_log(spark, sf_dir).groupBy("conv_id").agg(F.sum(F.coalesce(F.length("content"), F.lit(0))).cast("long").alias("chars"), F.sum(size).cast("long").alias("json_chars"))


@query("content_fallback", "with m as (select conv_id, turn, regexp_extract(text, '^[^.?!]*[.?!]') as first, regexp_replace(text, '^[^.?!]*[.?!]\\s*', '') as rest from conversations) select conv_id, turn as seq, coalesce(nullif(rest, ''), nullif(first, '')) as content from m")
def content_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-08: a reply's content, else its reasoning, else nothing; empty counts as missing. Here the first sentence of a message is the
    reasoning and the rest the content, which a message of one sentence lacks."""
    rest, first = F.regexp_replace("content", r"^[^.?!]*[.?!]\s*", ""), F.regexp_extract("content", r"^[^.?!]*[.?!]", 0)
    return event_log(spark, sf_dir).select("conv_id", "seq", F.coalesce(F.nullif(rest, F.lit("")), F.nullif(first, F.lit(""))).alias("content"))


@query("step_durations", f"with {CALLS_SQL} select id, (epoch_us(created_at) - epoch_us(lag(created_at) over (partition by conv_id order by created_at, id))) // 1000 as ms from calls")
def step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-12: milliseconds since the step before."""
    by = Window.partitionBy("conv_id").orderBy("created_at", "id")
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    return call_logs(spark, sf_dir).select("id", "conv_id", "created_at", us.alias("us")).select("id", F.floor((F.col("us") - F.lag("us").over(by)) / 1000).cast("long").alias("ms"))


@query("sorted_keys", f"with {FIELDS_SQL}, d as (select distinct form_id, 'k' || field_key as k from fields) select form_id, string_agg(k, ',' order by k) as keys from d group by form_id")
def sorted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-07: an object's keys in order; the object of a form has its fields as keys, in the order of the form."""
    fields = first_of_each_key(form_fields(spark, sf_dir))
    pair = F.struct("pos", F.format_string('"k%d": [%d]', "field_key", "width").alias("t"))
    docs = fields.groupBy("form_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]), ", "), F.lit("}")).alias("doc"))
    return docs.select("form_id", F.array_join(F.array_sort(F.json_object_keys("doc")), ",").alias("keys"))


@query("deep_equality", f"with {BASE_SQL} select form_id, count(*) filter (where type_code = 4) = 0 and (max(width) <= 40 or list(width order by pos) = list(width order by pos desc)) as same from base group by form_id")
def deep_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-30: documents are equal whatever the order of their keys and white space; the order of arrays counts. The second document of
    a form has its keys the other way round, other values for some types, and, where a field is wide, its list backwards."""
    fields = first_of_each_key(form_fields(spark, sf_dir))
    said = lambda w: F.format_string('"k%d":{"w":%d,"p":[%d]}', "field_key", w, "pos")
    parts = F.struct("pos", said(F.col("width")).alias("a"), said(F.when(F.col("type_code") == 4, F.col("width") + 1).otherwise(F.col("width"))).alias("b"), F.col("width").cast("string").alias("w"))
    docs = fields.groupBy("form_id").agg(F.array_sort(F.collect_list(parts)).alias("l"), (F.max("width") > 40).alias("wide"))
    texts = lambda part, l: F.array_join(F.transform(l, lambda x: x[part]), ", ")
    whole = lambda part, l, list_: F.to_json(F.parse_json(F.concat(F.lit("{ "), texts(part, l), F.lit(',"list":['), texts("w", list_), F.lit("]}"))))  # noqa: E731  a variant keeps its keys in order
    back = F.reverse("l")
    return docs.select("form_id", (whole("a", F.col("l"), F.col("l")) == whole("b", back, F.when(F.col("wide"), back).otherwise(F.col("l")))).alias("same"))


_PACK_SQL = "packs as (select p_partkey as id, p_name as name, case when p_size % 3 <> 0 then p_type end as kind, p_size, p_brand from part)"


@query("pack_manifests", f"with {_PACK_SQL} select id, to_json({{'name': name, 'artifact': {{'type': coalesce(kind, 'config'), 'actions': case when p_size % 2 = 0 then ['apply', 'rewind'] else ['view_json'] end}}, 'services': case when p_size % 5 = 0 then [] else [p_brand] end, 'tools': [{{'name': 'chat', 'when': ''}}, {{'name': 't' || p_size, 'when': name}}]}})::varchar as manifest from packs")
def pack_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-13: what a front end is told of a pack; type and actions have defaults."""
    kind = F.when(F.col("p_size") % 3 != 0, F.col("p_type"))
    actions = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("apply"), F.lit("rewind")))
    services = F.when(F.col("p_size") % 5 != 0, F.array("p_brand"))
    tool = lambda name, when: F.struct(name.alias("name"), F.coalesce(when, F.lit("")).alias("when"))
    artifact = F.struct(F.coalesce(kind, F.lit("config")).alias("type"), F.coalesce(actions, F.array(F.lit("view_json"))).alias("actions"))
    manifest = F.struct(F.col("p_name").alias("name"), artifact.alias("artifact"), F.coalesce(services, F.array().cast("array<string>")).alias("services"), F.array(tool(F.lit("chat"), F.lit(None).cast("string")), tool(F.concat(F.lit("t"), F.col("p_size").cast("string")), F.col("p_name"))).alias("tools"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.to_json(manifest).alias("manifest"))


_PACKS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


@query("enabled_packs", f"""with a as (select c_custkey as id, list(distinct o_orderpriority order by o_orderpriority) filter (where o_orderpriority is not null) as allowed from customer left join orders on o_custkey = c_custkey group by c_custkey)
select id, array_to_string(case when allowed is null then {list(_PACKS)} else list_filter({list(_PACKS)}, lambda p: list_contains(allowed, p)) end, ',') as enabled,
  array_to_string(list_filter(coalesce(allowed, []), lambda p: not list_contains({list(_PACKS)}, p)), ',') as unknown from a""")
def enabled_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-14: the packs that a list allows, in their own order, and its names that no pack has; no list allows all. A customer's list
    is the priorities of their orders; who has no orders has no list."""
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("allowed"))
    packs = F.array(*map(F.lit, _PACKS))
    enabled = F.when(F.col("allowed").isNull(), packs).otherwise(F.filter(packs, lambda p: F.array_contains("allowed", p)))
    unknown = F.array_sort(F.array_except(F.coalesce("allowed", F.array().cast("array<string>")), packs))
    both = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(lists, "id", "left")
    return both.select("id", F.array_join(enabled, ",").alias("enabled"), F.array_join(unknown, ",").alias("unknown"))
