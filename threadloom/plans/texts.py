"""Text queries: tokens, redaction, sanitising, JSON extraction, event-stream frames, error messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators.replays import frame_step, replayed, unfinished
from ..sources.tables import event_log, table
from .base import query
from .conversations import tokens_sql

#: A whole text with a secret of each kind before it.
_SECRETS = "concat('Authorization: Bearer ', md5(text), ' key=sk-', substr(md5(text), 1, 12), ' Cookie: sid=', md5(source), '; x-api-key: ', md5(lang), ' eyJ', md5(text), '.eyJ', md5(lang), '.', md5(source), ' ', text)"


def _redact_sql(text: str) -> str:
    for pattern, keep in T.SECRET_RULES:
        flag = "gi" if pattern.startswith("(?i)") else "g"
        text = "regexp_replace({}, '{}', '{}', '{}')".format(text, pattern.removeprefix("(?i)").replace("'", "''"), keep.replace("$", "\\"), flag)
    return text


@query("estimate_tokens", f"select doc_id, {tokens_sql('t')} as tokens from (select doc_id, text || repeat('中', (doc_id % 7)::int) as t from documents)")
def estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-01."""
    t = F.concat("text", F.repeat(F.lit("中"), (F.col("doc_id") % 7).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(t).alias("tokens"))


@query("session_tokens", f"select conv_id, (sum({tokens_sql('text')}) + 4 * count(*))::bigint as tokens from conversations group by conv_id")
def session_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-02."""
    return event_log(spark, sf_dir).groupBy("conv_id").agg((F.sum(T.estimate_tokens(F.col("content"))) + 4 * F.count(F.lit(1))).alias("tokens"))


@query("should_compress", f"select conv_id, sum({tokens_sql('text')}) + 4 * count(*) > {T.compress_trigger(10_000)} as tiny, sum({tokens_sql('text')}) + 4 * count(*) > {T.compress_trigger(200_000)} as large from conversations group by conv_id")
def should_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-03, I-02: a window below the reserve has a negative trigger and always compresses."""
    return session_tokens(spark, sf_dir).select("conv_id", (F.col("tokens") > T.compress_trigger(10_000)).alias("tiny"), (F.col("tokens") > T.compress_trigger(200_000)).alias("large"))


@query("redact_secrets", f"select doc_id, {_redact_sql(_SECRETS)} as redacted from documents")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-05."""
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.expr(_SECRETS)).alias("redacted"))


_ODD_SQL = "text || chr(8203) || 'x' || chr(8238) || chr(65279) || chr(57344) || 'y' || chr(8288)"


@query("sanitize_ranges", f"select doc_id, regexp_replace({_ODD_SQL}, '{T.DROPPED}', '', 'g') as clean from documents")
def sanitize_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-03, the native part."""
    odd = F.concat(F.col("text"), F.lit("​x‮﻿y⁠"))
    return table(spark, sf_dir, "documents").select("doc_id", T.drop_invisible(odd).alias("clean"))


@query("sanitize_nfkc")
def sanitize_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-03 with compatibility composition, which DuckDB lacks; tested against Python's own."""
    odd = F.concat(F.lit("ＡＢＣ​①ﬁ"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.sanitize(odd).alias("clean"))


@query("json_payload_extract", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, props is not null as has_props from events")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-06: a typed path of an open document."""
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), F.col("props").isNotNull().alias("has_props"))


@query("json_from_text", "select event_id, case when event_id % 4 = 3 then null else cast(json_extract(props, '$.k') as bigint) end as k from events")
def json_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-07: the three places where a model may put its JSON, and none."""
    kind = F.col("event_id") % 4
    fence = F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nbye"))
    reply = F.when(kind == 0, F.col("props")).when(kind == 1, fence).when(kind == 2, F.concat(F.lit("so "), "props", F.lit(" it is"))).otherwise(F.lit("no json here"))
    found = T.json_from_text(F.col("reply"))
    return table(spark, sf_dir, "events").withColumn("reply", reply).select("event_id", F.try_variant_get(F.try_parse_json(found), "$.k", "bigint").alias("k"))


@query("sse_format", "select event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) as frame from events")
def sse_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-20."""
    return table(spark, sf_dir, "events").select("event_id", T.sse_frame(F.col("event_type"), F.col("props")).alias("frame"))


#: Each frame comes in three chunks, cut within its first line and before its last character. Views tell their JSON in two data
#: lines, purchases name two events, errors none; users with an even id end within a frame. Some data is not JSON.
_FRAMES_SQL = "f as (select *, value < 20 as bad, user_id % 2 = 0 and event_id = max(event_id) over (partition by user_id) as torn from events)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max("event_id").over(Window.partitionBy("user_id"))
    events = table(spark, sf_dir, "events").withColumn("torn", (F.col("user_id") % 2 == 0) & (F.col("event_id") == last))
    kind = F.col("event_type")
    told = F.when(kind == "error", F.lit(": a comment")).when(kind == "purchase", F.concat(F.lit("event: draft\nevent:\t"), kind, F.lit(" "))).otherwise(F.concat(F.lit("event:"), kind))
    colon = F.instr("props", ":")
    cut = F.concat(F.lit("data: "), F.substr("props", F.lit(1), colon), F.lit(" \ndata:"), F.substr("props", colon + 1))
    data = F.when(F.col("value") < 20, F.lit("data: {not json")).when(kind == "view", cut).otherwise(F.concat(F.lit("data: "), F.col("props")))
    frame = F.concat(told, F.lit("\nid: 1\n"), data, F.when(F.col("torn"), "\n").otherwise("\n\n"))
    size = F.length("frame")
    parts = F.posexplode(F.array(F.substring("frame", 1, 9), F.substr("frame", F.lit(10), size - 10), F.substr("frame", size))).alias("part", "text")
    return events.select("user_id", "event_id", frame.alias("frame")).select("user_id", "event_id", parts)


@query("sse_parse", f"with {_FRAMES_SQL} select user_id, event_type as event, count(*) as frames, sum(case when not bad then cast(json_extract(props, '$.k') as bigint) end)::bigint as total, sum(bad::int)::bigint as broken from f where not torn and event_type <> 'error' group by 1, 2")
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-18, A-19, K-07: the frames of each user's stream of chunks, put together over the chunks' ends and taken apart: the last event
    line and all data lines count; frames without an event and one that never ends are not told; what is not JSON counts as {}."""
    found = replayed(_chunks(spark, sf_dir), ["user_id"], ["event_id", "part"], ["text"], frame_step, "frame string, whole boolean", unfinished)
    frames = found.where("whole").select("user_id", T.sse_event(F.col("frame")).alias("event"), F.try_parse_json(T.sse_data(F.col("frame"))).alias("data")).where("event is not null")
    data = F.coalesce("data", F.parse_json(F.lit("{}")))
    return frames.groupBy("user_id", "event").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.try_variant_get(data, "$.k", "bigint")).alias("total"), F.count_if(F.col("data").isNull()).alias("broken"))


_ERRORS_SQL = """errors as (select event_id, user_id, case event_id % 3 when 0 then 'Unrecognized field "f' || user_id || '" (class X)' when 1 then 'D: k' || user_id || '.p' || (event_id % 5) || ' 为必填项(字段类型=USER)' else 'D: k' || user_id || '.p=0 不合法,类型SEGMENT 允许值=[1, 2,' || (event_id % 5) || ']' end as message from events)"""


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation messages of the three formats that name what can be mended."""
    user, fifth = F.col("user_id").cast("string"), (F.col("event_id") % 5).cast("string")
    kind = F.col("event_id") % 3
    message = F.when(kind == 0, F.concat(F.lit('Unrecognized field "f'), user, F.lit('" (class X)'))).when(kind == 1, F.concat(F.lit("D: k"), user, F.lit(".p"), fifth, F.lit(" 为必填项(字段类型=USER)"))).otherwise(F.concat(F.lit("D: k"), user, F.lit(".p=0 不合法,类型SEGMENT 允许值=[1, 2,"), fifth, F.lit("]")))
    return table(spark, sf_dir, "events").select("event_id", "user_id", message.alias("message"))


@query("error_parse", f"""with {_ERRORS_SQL} select event_id, case event_id % 3 when 0 then 'f' || user_id end as unknown_field, case when event_id % 3 <> 0 then 'k' || user_id end as field_key,
  case event_id % 3 when 1 then 'p' || (event_id % 5) when 2 then 'p' end as prop, case event_id % 3 when 1 then 'USER' when 2 then 'SEGMENT' end as type_name, case when event_id % 3 = 2 then '1|2|' || (event_id % 5) end as allowed from errors""")
def error_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-19, I-20, I-21: the unknown field, or field, property, type and allowed values of what is missing or not allowed."""
    m = F.col("message")
    part = lambda p, k: F.nullif(F.regexp_extract(m, p, k), F.lit(""))
    either = lambda k: F.coalesce(part(T.MISSING_VALUE, k), part(T.INVALID_VALUE, k))
    allowed = F.array_join(T.csv_list(part(T.INVALID_VALUE, 4)), "|")
    return errors(spark, sf_dir).select("event_id", part(T.UNKNOWN_FIELD, 1).alias("unknown_field"), either(1).alias("field_key"), either(2).alias("prop"), either(3).alias("type_name"), allowed.alias("allowed"))


_RAW_SQL = "raw as (select event_id, event_id % 4 as kind, 'E' || event_id as said from events)"


@query("error_normalise", f"""with {_RAW_SQL} select event_id, case kind when 3 then '' else said end as message, case kind when 0 then '[{{"message":"' || said || '"}}]' when 1 then '[{{"message":"' || said || '"}},{{"code":7,"message":"b"}}]' when 2 then '[{{"message":"' || said || '"}}]' else '[]' end as errors from raw""")
def error_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-22, I-23: errors come as texts or objects; each as a text to compare by, all as objects with a message."""
    said = F.concat(F.lit("E"), F.col("event_id").cast("string"))
    text, obj = F.to_json(F.struct(said.alias("e"))), F.to_json(F.struct(F.struct(said.alias("message")).alias("e")))
    quoted = F.get_json_object(F.lit('{"e":{"code":7,"message":"b"}}'), "$.e")
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.array(F.struct(text.alias("x")))).when(kind == 1, F.array(F.struct(text.alias("x")), F.struct(F.concat(F.lit('{"e":'), quoted, F.lit("}")).alias("x")))).when(kind == 2, F.array(F.struct(obj.alias("x"))))
    rows = table(spark, sf_dir, "events").select("event_id", F.coalesce(raw, F.array().cast("array<struct<x:string>>")).alias("raw"))
    message = lambda x: F.coalesce(F.get_json_object(x["x"], "$.e.message"), F.get_json_object(x["x"], "$.e"))
    whole = lambda x: F.when(F.get_json_object(x["x"], "$.e.message").isNotNull(), F.get_json_object(x["x"], "$.e")).otherwise(F.to_json(F.struct(message(x).alias("message"))))
    return rows.select("event_id", F.coalesce(message(F.try_element_at("raw", F.lit(1))), F.lit("")).alias("message"), F.concat(F.lit("["), F.array_join(F.transform("raw", whole), ","), F.lit("]")).alias("errors"))


@query("differential_errors", f"with {_ERRORS_SQL} select n.event_id, n.message from errors n where n.event_id % 2 = 0 and not exists (select 1 from errors b where b.event_id % 2 = 1 and b.user_id = n.user_id and b.message = n.message)")
def differential_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-11, H-06, J-27: errors that the baseline did not have; repeats stay."""
    found = errors(spark, sf_dir)
    baseline = found.where("event_id % 2 = 1").select("user_id", "message").distinct()
    return found.where("event_id % 2 = 0").join(baseline, ["user_id", "message"], "left_anti").select("event_id", "message")


@query("clone_identity", "select o_orderkey as form_id, 'form' || o_orderkey || '_copy' as form_code, case when o_orderpriority = '' then '' else o_orderpriority end || '(副本)' as form_name from orders")
def clone_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-23, I-17: the default identity of a copy; audit columns are not carried."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("form_id"), F.concat(F.lit("form"), F.col("o_orderkey").cast("string"), F.lit("_copy")).alias("form_code"), F.concat("o_orderpriority", F.lit("(副本)")).alias("form_name"))
