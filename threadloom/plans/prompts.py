"""Prompts filled from columns by compiled templates, and a request pipeline whose steps are written one by one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import templates
from ..operators import steps
from ..sources.stored import shared_dir
from ..sources.tables import BASE_SQL, META_SQL, first_of_each_key, form_fields, session_meta
from .base import query

_INTRO = "---\ncacheable: true\n---\n你是表单助手。\n"
_MAIN = """{# what the model sees of a form #}
表单 {{ title }}{% if note %}（{{ note }}）{% else %}（无备注）{% endif %}
{%- for f in fields %}
{{ loop.index }}. k{{ f.key }} 宽 {{ f.width }}{% if f.required %} 必填{% endif %}{% if not f.tags %} 无标签{% endif %}{% for t in f.tags %} #{{ t }}{% endfor %}
{%- endfor %}
数据: {{ first | tojson }}
"""


@query("compiled_prompts", f"""with {BASE_SQL}, n as (select *, row_number() over (partition by form_id order by pos) as i from base),
l as (select form_id, max(case when i = 1 and flag = 'F' then 'f' || width end) as note, sum(width) as total, string_agg(chr(10) || i || '. k' || field_key || ' 宽 ' || width || case when required then ' 必填' else '' end || case when type_code < 3 then ' #a #t' || type_code else ' 无标签' end, '' order by i) as listed,
  max(case when i = 1 then '{{"key": ' || field_key || ', "width": ' || width || ', "required": ' || required::varchar || ', "tags": ' || case when type_code < 3 then '["a", "t' || type_code || '"]' else '[]' end || '}}' end) as first from n group by form_id)
select form_id, case when total > 200 then 'form ' || form_id || ' is too wide' else '---' || chr(10) || 'cacheable: true' || chr(10) || '---' || chr(10) || '你是表单助手。' || chr(10) || chr(10) || chr(10) || '表单 form' || form_id || '（' || coalesce(note, '无备注') || '）' || listed || chr(10) || '数据: ' || first
  || case when total > 100 then chr(10) || chr(10) || 'keep "it", short: ' || total else '' end end as prompt from l""")
def compiled_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-10, L-11: a static section, a template with lists, conditions and JSON, an override or an appended rule by the data."""
    tags = F.when(F.col("type_code") < 3, F.array(F.lit("a"), F.concat(F.lit("t"), F.col("type_code").cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = first_of_each_key(form_fields(spark, sf_dir)).select("form_id", "pos", "width", "flag", F.struct(F.col("field_key").alias("key"), "width", "required", tags.alias("tags")).alias("f"))
    by = rows.groupBy("form_id").agg(F.array_sort(F.collect_list(F.struct("pos", "f"))).alias("l"), F.sum("width").alias("total"), F.min_by(F.when(F.col("flag") == "F", F.concat(F.lit("f"), F.col("width").cast("string"))).otherwise(""), "pos").alias("note"))
    forms = by.select("form_id", "total", F.concat(F.lit("form"), F.col("form_id").cast("string")).alias("title"), "note", F.transform("l", lambda x: x["f"]).alias("fields"), F.col("l")[0]["f"].alias("first"))
    override = F.when(F.col("total") > 200, F.concat(F.lit("form "), F.col("form_id").cast("string"), F.lit(" is too wide")))
    append = F.when(F.col("total") > 100, F.concat(F.lit('keep "it", short: '), F.col("total").cast("string"))).otherwise(" ")
    return forms.select("form_id", templates.assembled(forms, [_INTRO], _MAIN, override, append).alias("prompt"))


def _parsed(rows: DataFrame) -> DataFrame:
    kind = F.nullif(F.lower(F.trim(F.regexp_replace("title", r"^\d-", ""))), F.lit(""))
    return rows.withColumn("leave_type", F.coalesce("leave_type", kind))


def _validated(rows: DataFrame) -> DataFrame:
    lacks = F.array_compact(F.array(F.when(F.col("leave_type").isNull() | (F.col("leave_type") == "not specified"), F.lit("leaveType")), F.when(F.col("context_key") == "P", F.lit("dates"))))
    return rows.withColumn("question", F.array_join(lacks, ","))


def _submitted(rows: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("updated_at", "conv_id"))
    return rows.withColumn("number", rank.cast("long"))


STEPS = [("parse", _parsed), ("validate", _validated), ("submit", _submitted)]


@query("resumable_requests", f"""with {META_SQL}, p as (select conv_id, user_id, context_key, updated_at, nullif(lower(trim(regexp_replace(title, '^\\d-', ''))), '') as t from meta),
q as (select *, concat_ws(',', case when t is null or t = 'not specified' then 'leaveType' end, case when context_key = 'P' then 'dates' end) as question from p)
select conv_id, 'done' as state, t as told, row_number() over (partition by user_id order by updated_at, conv_id)::bigint as number from q where question = ''
union all select conv_id, 'validate', question, null from q where question <> ''""")
def resumable_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-02, K-19, K-09: requests go through three written steps; those that lack something wait at the second. The run is cut after
    each step and goes on from what is there."""
    path = f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
    rows = session_meta(spark, sf_dir).withColumn("leave_type", F.lit(None).cast("string"))
    for upto in range(1, len(STEPS) + 1):
        done = steps.run(rows, STEPS[:upto], path)
    waiting = steps.asked(spark, path, STEPS, ["conv_id"])
    return done.select("conv_id", F.lit("done").alias("state"), F.col("leave_type").alias("told"), "number").unionByName(waiting.select("conv_id", F.col("step").alias("state"), F.col("question").alias("told"), F.lit(None).cast("long").alias("number")))
