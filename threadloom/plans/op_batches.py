"""Batches of ops on typed forms, folded in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import op_fold as P, open_documents as O
from ..sources.tables import BASE_SQL, first_of_each_key, form_fields
from .base import query


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form a row: fields in order, form values, buttons, and what the choice of ops depends on."""
    key = F.concat(F.lit("k"), F.col("field_key").cast("string"))
    field = F.struct(key.alias("key"), F.concat(F.lit("题"), F.col("pos").cast("string")).alias("title"), F.col("type_code").alias("type"), F.create_map(F.lit("fieldWidth"), F.col("width").cast("string")).alias("values"))
    rows = first_of_each_key(form_fields(spark, sf_dir)).select("form_id", "pos", "type_code", "required", "width", field.alias("f"))
    # A struct with a map has no order, so the list is put in order by place first and looked up after.
    by = rows.groupBy("form_id").agg(F.collect_list(F.struct("pos", "f")).alias("l"), F.bool_or("required").alias("any_required"), F.max("width").alias("widest"), F.bool_or(F.col("type_code") == 4).alias("has_4"), F.bool_or((F.col("type_code") == 7) & (F.col("width") > 40)).alias("wide_7"))
    order = F.array_sort(F.transform("l", lambda x, i: F.struct(x["pos"].alias("pos"), i.alias("i"))))
    button = lambda part, name: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), F.create_map(F.lit("buttonType"), F.lit("primary")).alias("values"))
    fields = F.transform(order, lambda o: F.get(F.col("l"), o["i"])["f"])
    return by.select("form_id", "any_required", "widest", "has_4", "wide_7", fields.cast(f"array<{P.FIELD}>").alias("fields"), F.create_map(F.lit("formName"), F.col("form_id").cast("string")).alias("form"), F.array(button("topButtons", "返回"), button("bottomButtons", "保存")).cast(f"array<{P.BUTTON}>").alias("buttons"))


def _op(**values: F.Column) -> F.Column:
    none = {"op": "string", "key": "string", "title": "string", "patch": "map<string,string>", "field": P.FIELD, "after": "string", "before": "string", "anchor_title": "string", "name": "string"}
    return F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in none.items()])


@query("apply_ops_fold", f"""with {BASE_SQL}, n as (select *, row_number() over (partition by form_id order by pos) as i, count(*) over (partition by form_id) as m from base),
d as (select form_id, max(m) as m, list('k' || field_key order by i) as keys, list(width order by i) as widths, bool_or(required) as req, max(width) as widest, bool_or(type_code = 4) as has_4, bool_or(type_code = 7 and width > 40) as rewrite from n group by form_id),
f as (select *, case when rewrite then [] else list_filter([case when req then '#5 add_field: key=''new'' 与现有字段重复' end, case when widest > 45 then '#6 update_field: 锚点未命中(key=''nope'' title=''none'')' end, case when has_4 then '#7 update_form: 不允许修改系统属性: [''owner'']' end], lambda x: x is not null) end as failures from d)
select form_id, not rewrite and len(failures) = 0 as ok, rewrite as full_rewrite, array_to_string(failures, chr(10)) as failures,
  case when rewrite or len(failures) > 0 then array_to_string(keys, ',') when m = 1 then 'new' else array_to_string([keys[1], 'new'] || keys[2:m - 1], ',') end as keys,
  case when rewrite or len(failures) > 0 then widths[1] else 99 end::bigint as first_width,
  case when rewrite or len(failures) > 0 then 'primary' else 'plain' end as button, case when rewrite or len(failures) > 0 then '' when m = 1 then keys[1] || ',new,' || keys[1] else keys[1] || ',new,' || keys[m] end as touched from f""")
def apply_ops_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-09 to J-16, D-06: a batch on each form: widen the first field (found by its title), put a new one of its type after it, remove the
    last of the old ones, press on a button or ask for a full rewrite, then ops that fail on some forms. All or nothing."""
    text, first = lambda s: F.lit(s), F.col("fields")[0]
    patch = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    new = F.struct(F.lit("new").alias("key"), F.lit(None).cast("string").alias("title"), first["type"].alias("type"), F.lit(None).cast("map<string,string>").alias("values"))
    ops = F.array(
        _op(op=text("update_field"), key=text("mistyped"), title=first["title"], patch=patch("fieldWidth", "99")),
        _op(op=text("add_field"), field=new, after=first["key"]),
        _op(op=text("remove_field"), key=F.element_at("fields", -1)["key"]),
        F.when(F.col("wide_7"), _op(op=text("full_rewrite"))).otherwise(_op(op=text("update_button"), name=text("保存"), patch=patch("buttonType", "plain"))),
        F.when(F.col("any_required"), _op(op=text("add_field"), field=new)).otherwise(_op(op=text("update_form"), patch=patch("formState", "1"))),
        F.when(F.col("widest") > 45, _op(op=text("update_field"), key=text("nope"), title=text("none"), patch=patch("a", "1"))).otherwise(_op(op=text("update_form"), patch=patch("formState", "2"))),
        F.when(F.col("has_4"), _op(op=text("update_form"), patch=patch("owner", "1"))).otherwise(_op(op=text("update_form"), patch=patch("formColumnsNumber", "2"))),
    )
    # The ops are a column before they are folded, so that they are made once a form.
    done = P.apply_ops(forms(spark, sf_dir).withColumn("ops", ops).select("form_id", "fields", "form", "buttons", "ops"))
    keys = F.array_join(F.transform("fields", lambda f: f["key"]), ",")
    return done.select("form_id", "ok", "full_rewrite", F.array_join("failures", "\n").alias("failures"), keys.alias("keys"), F.col("fields")[0]["values"]["fieldWidth"].cast("long").alias("first_width"), F.col("buttons")[1]["values"]["buttonType"].alias("button"), F.array_join("touched", ",").alias("touched"))
