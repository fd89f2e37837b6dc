"""Paths, values, answers, registries and the steps that lead up to a retry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..sources.tables import CALLS_SQL, FIELDS_SQL, call_logs, event_log, form_fields, table
from .base import query
from .conversations import CONTEXT_LIMIT, KEEP_RECENT, tokens_sql
from .texts import _ERRORS_SQL, errors

# Limits of the retry steps, and the texts that are shown.
PEELS, PEEL_SHARE, PEELED_CHARS, PROMPT_CHARS = 3, 0.2, 500, 900
MOST_KEYS, MOST_MESSAGES, MESSAGE_CHARS = 40, 3, 60
NULL_SHOWN, OBJECT_SHOWN = "空", "{…}"

_PATHS_SQL = "paths as (select event_id, case event_id % 4 when 0 then 'fields[k' || user_id || '].width' when 1 then 'rows.' || (event_id % 10) || '.' || event_type when 2 then '[k' || user_id || '].sub[x]' else event_type end as path from events)"


@query("path_normalise", f"""with {_PATHS_SQL} select event_id, array_to_string(list_filter(list_transform(string_split(path, '.'), lambda s: case when regexp_full_match(s, '[0-9]+') then '*' when s like '[%' then '*' when contains(s, '[') then split_part(s, '[', 1) || '.*' else s end), lambda s: s <> ''), '.') as pattern,
  string_split(path, '.')[-1] as prop, case event_id % 4 when 0 then 'fields' when 1 then 'rows' when 2 then 'k' || user_id || ']' else event_type end as owner from paths join events using (event_id)""")
def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-25, I-27: labels and numbers of array elements become stars; the first and last part of a path."""
    user, kind = F.col("user_id").cast("string"), F.col("event_id") % 4
    path = F.when(kind == 0, F.concat(F.lit("fields[k"), user, F.lit("].width"))).when(kind == 1, F.concat(F.lit("rows."), (F.col("event_id") % 10).cast("string"), F.lit("."), "event_type")).when(kind == 2, F.concat(F.lit("[k"), user, F.lit("].sub[x]"))).otherwise(F.col("event_type"))

    def part(s: F.Column) -> F.Column:
        bare = F.regexp_replace(s, r"\[[^\]]*\]", "")
        return F.when(s.contains("["), F.when(bare != "", F.concat(bare, F.lit(".*"))).otherwise("*")).when(s.rlike(r"^\d+$"), "*").otherwise(s)

    parts = F.split("path", r"\.")
    owner = F.element_at(F.split(F.regexp_replace("path", r"^\[|\]$", ""), r"[.\[]"), 1)
    paths = table(spark, sf_dir, "events").select("event_id", path.alias("path"))
    return paths.select("event_id", F.array_join(F.filter(F.transform(parts, part), lambda s: s != ""), ".").alias("pattern"), F.element_at(parts, -1).alias("prop"), F.coalesce(F.nullif(owner, F.lit("")), F.col("path")).alias("owner"))


@query("value_format", f"select event_id, case event_id % 3 when 0 then '{NULL_SHOWN}' when 1 then '{OBJECT_SHOWN}' else json_extract_string(props, '$.k') end as shown from events")
def value_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-26: a missing value, an object or array, or the value as text."""
    v = F.try_parse_json("props")
    whole, k = F.schema_of_variant(v), F.try_variant_get(v, "$.k", "string")
    shown = F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string")).when((F.col("event_id") % 3 == 1) & whole.rlike("^(OBJECT|ARRAY)"), OBJECT_SHOWN).otherwise(k)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(shown, F.lit(NULL_SHOWN)).alias("shown"))


@query("allowed_value_cast", "select event_id, case when event_id % 2 = 0 then event_id - 500 end as as_int, case when event_id % 2 = 0 then null else event_type end as as_text from events")
def allowed_value_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-24: an allowed value that reads as a whole number is one, any other stays text."""
    value = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") - 500).cast("string")).otherwise(F.col("event_type"))
    whole = F.col("value").rlike(r"^-?\d+$")
    allowed = table(spark, sf_dir, "events").select("event_id", value.alias("value"))
    return allowed.select("event_id", F.when(whole, F.col("value").try_cast("long")).alias("as_int"), F.when(~whole, F.col("value")).alias("as_text"))


@query("clarify_answers", "select event_id, event_type || case when event_id % 3 = 2 then '' else chr(10) || '（用户补充回答：' || case when event_id % 3 = 0 then 'free ' || user_id else 'kind: ' || event_type || '；user: ' || user_id end || '）' end as input from events")
def clarify_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-28, I-29: answers join the input of the run that is resumed; a free text wins over the pairs, none adds nothing."""
    third, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    pairs = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), user)
    answers = F.when(third == 0, F.map_concat(pairs, F.create_map(F.lit("text"), F.concat(F.lit("free "), user)))).when(third == 1, pairs)
    said = F.transform(F.map_entries(F.map_filter("answers", lambda k, v: k != "text")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    extra = F.coalesce(F.nullif(F.try_element_at("answers", F.lit("text")), F.lit("")), F.nullif(F.array_join(said, "；"), F.lit("")))
    added = F.coalesce(F.concat(F.lit("\n（用户补充回答："), extra, F.lit("）")), F.lit(""))
    return table(spark, sf_dir, "events").withColumn("answers", answers).select("event_id", F.concat("event_type", added).alias("input"))


@query("interrupt_resume", f"with {CALLS_SQL} select q.id, (select min_by(a.id, (a.created_at, a.id)) from calls a where a.conv_id = q.conv_id and a.call_type <> 'error' and (a.created_at, a.id) > (q.created_at, q.id)) as resumed_by from calls q where q.call_type = 'error'")
def interrupt_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-09: each question (an error) with the first later answer of its session, null while it waits.

    Read backwards, so that the frame grows by one row at a time."""
    later = Window.partitionBy("conv_id").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    answer = F.last(F.when(F.col("call_type") != "error", F.col("id")), ignorenulls=True).over(later)
    calls = call_logs(spark, sf_dir).select("id", "conv_id", "call_type", "created_at")
    return calls.withColumn("resumed_by", answer).where("call_type = 'error'").select("id", "resumed_by")


@query("validation_summary", f"with {_ERRORS_SQL}, r as (select *, row_number() over (partition by user_id order by event_id) as rn from errors) select user_id, count(*) as n_errors, string_agg(substr(message, 1, {MESSAGE_CHARS}), '; ' order by rn) filter (where rn <= {MOST_MESSAGES}) as first_messages from r group by user_id")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-13, G-06: how many messages, and the first three of them, cut."""
    ranked = errors(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    shown = F.when(F.col("rn") <= MOST_MESSAGES, F.struct("rn", F.substring("message", 1, MESSAGE_CHARS).alias("m")))
    by = ranked.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_errors"), F.array_sort(F.collect_list(shown)).alias("shown"))
    return by.select("user_id", "n_errors", F.array_join(F.transform("shown", lambda x: x["m"]), "; ").alias("first_messages"))


@query("format_failures", f"with {FIELDS_SQL} select form_id, string_agg('- ' || field_key, chr(10) order by pos) filter (where type_code = 3) as failures, string_agg(field_key::varchar, ',' order by pos) filter (where pos <= {MOST_KEYS}) as legal_keys from fields group by form_id having count(*) filter (where type_code = 3) > 0")
def format_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-18: what a retry is told of a form: its failures (type 3), and up to 40 keys that it may use. Forms without any have no row."""
    fields = form_fields(spark, sf_dir).select("form_id", "pos", "type_code", F.col("field_key").cast("string").alias("k"))
    listed = lambda when: F.array_sort(F.collect_list(F.when(when, F.struct("pos", "k"))))
    by = fields.groupBy("form_id").agg(listed(F.col("type_code") == 3).alias("bad"), listed(F.col("pos") <= MOST_KEYS).alias("keys"))
    lines = F.array_join(F.transform("bad", lambda x: F.concat(F.lit("- "), x["k"])), "\n")
    return by.where(F.size("bad") > 0).select("form_id", lines.alias("failures"), F.array_join(F.transform("keys", lambda x: x["k"]), ",").alias("legal_keys"))


_PEEL_SQL = f"l[floor(len(l) * {PEEL_SHARE}::double)::bigint + 1:]"


@query("ptl_peel", f"""with t0 as (select page_id, string_split(html, chr(10)) as l, 0 as peels from pages),
t1 as (select page_id, case when length(array_to_string(l, chr(10))) > {PROMPT_CHARS} then {_PEEL_SQL} else l end as l, peels + (length(array_to_string(l, chr(10))) > {PROMPT_CHARS})::int as peels from t0),
t2 as (select page_id, case when length(array_to_string(l, chr(10))) > {PROMPT_CHARS} then {_PEEL_SQL} else l end as l, peels + (length(array_to_string(l, chr(10))) > {PROMPT_CHARS})::int as peels from t1),
t3 as (select page_id, case when length(array_to_string(l, chr(10))) > {PROMPT_CHARS} then {_PEEL_SQL} else l end as l, peels + (length(array_to_string(l, chr(10))) > {PROMPT_CHARS})::int as peels from t2)
select page_id, peels, peels = {PEELS} as degraded, case when peels = {PEELS} then substr(array_to_string(l, chr(10)), 1, {PEELED_CHARS}) else array_to_string(l, chr(10)) end as prompt from t3""")
def ptl_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-13, K-14: a prompt that is too long loses its oldest fifth of lines, at most three times; after the third refusal its
    first characters are all that is kept."""

    def peel(state: F.Column, _: F.Column) -> F.Column:
        lines = state["lines"]
        over = F.length(F.array_join(lines, "\n")) > PROMPT_CHARS
        first = F.floor(F.size(lines) * PEEL_SHARE).cast("int") + 1
        return F.struct(F.when(over, F.slice(lines, first, F.size(lines))).otherwise(lines).alias("lines"), (state["peels"] + over.cast("int")).alias("peels"))

    zero = F.struct(F.split(F.coalesce("html", F.lit("")), "\n").alias("lines"), F.lit(0).alias("peels"))
    peeled = table(spark, sf_dir, "pages").select("page_id", F.aggregate(F.sequence(F.lit(1), F.lit(PEELS)), zero, peel).alias("s"))
    prompt, degraded = F.array_join("s.lines", "\n"), F.col("s.peels") == PEELS
    return peeled.select("page_id", F.col("s.peels").alias("peels"), degraded.alias("degraded"), F.when(degraded, F.substring(prompt, 1, PEELED_CHARS)).otherwise(prompt).alias("prompt"))


@query("sidechain_compression", f"with m as (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) select conv_id, (sum({tokens_sql('text')}) + 4 * count(*))::bigint as tokens_before, count(*) filter (where rn > {KEEP_RECENT}) as n_old, min(turn) filter (where rn <= {KEEP_RECENT}) as kept_from from m group by conv_id having sum({tokens_sql('text')}) + 4 * count(*) > {T.compress_trigger(CONTEXT_LIMIT)} and count(*) > {KEEP_RECENT}")
def sidechain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-12: the conversations whose old part is to be summarised, and where the part that is answered from at once begins."""
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("seq")))
    tokens = F.sum(T.estimate_tokens(F.col("content"))) + 4 * F.count(F.lit(1))
    by = event_log(spark, sf_dir).withColumn("rn", rn).groupBy("conv_id").agg(tokens.alias("tokens_before"), F.count_if(F.col("rn") > KEEP_RECENT).alias("n_old"), F.min(F.when(F.col("rn") <= KEEP_RECENT, F.col("seq"))).alias("kept_from"))
    return by.where((F.col("tokens_before") > T.compress_trigger(CONTEXT_LIMIT)) & (F.col("n_old") > 0))


@query("merge_registries", "select p_type as name, p_partkey as tool from (select *, row_number() over (partition by p_type order by p_size > 25 desc, p_partkey desc) as rn from part) where rn = 1")
def merge_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-05, D-15, L-06: tools of two registries by name; the second (sizes above 25) wins, then the later registration."""
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("tool"), "p_size")
    both = part.where("p_size <= 25").select("name", "tool", F.lit(1).alias("registry")).unionByName(part.where("p_size > 25").select("name", "tool", F.lit(2).alias("registry")))
    return both.groupBy("name").agg(F.max_by("tool", F.struct("registry", "tool")).alias("tool"))


@query("context_precedence", "select e.event_id, coalesce(case when e.event_id % 3 = 2 then e.props end, o.o_orderpriority, 'none') as config from events e left join orders o on o.o_orderkey = e.user_id")
def context_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-07, C-08: the host's document, else the stored one; an empty object counts as none."""
    third = F.col("event_id") % 3
    host = F.when(third == 0, "{}").when(third == 2, F.col("props"))
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("user_id"), F.col("o_orderpriority").alias("stored"))
    joined = table(spark, sf_dir, "events").select("event_id", "user_id", host.alias("host")).join(stored, "user_id", "left")
    return joined.select("event_id", F.coalesce(F.nullif("host", F.lit("{}")), "stored", F.lit("none")).alias("config"))


@query("key_inventory", "select k as key, count(*) as n from (select unnest(json_keys(props)) as k from events) group by k")
def key_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-08, H-07: the keys of all open documents and how many documents have them."""
    keys = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("unknown_packs", "select o_orderkey as id, array_to_string(list_filter([lower(o_orderstatus), 'form', case when o_orderkey % 2 = 0 then 'leave' else 'misc' end], lambda x: x not in ('form', 'leave', 'o')), ',') as unknown from orders")
def unknown_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-02, H-03: names that are not known."""
    wanted = F.array(F.lower("o_orderstatus"), F.lit("form"), F.when(F.col("o_orderkey") % 2 == 0, "leave").otherwise("misc"))
    known = F.array(F.lit("form"), F.lit("leave"), F.lit("o"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.array_except(wanted, known), ",").alias("unknown"))
