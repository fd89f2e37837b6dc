"""Form documents as rows of fields: catalog, patches, restore, repair, diffs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import linediff, open_documents as O
from ..sources.tables import BASE_SQL, FIELDS_SQL, first_of_each_key, form_fields, table
from .base import query

_NEW_SQL = "new as (select form_id, pos, case when type_code = 7 then field_key + 1000000 else field_key end as field_key, type_code, required, case when required then width + 1 else width end as width, flag from base where type_code <> 4)"


def base_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_each_key(form_fields(spark, sf_dir))


def both_versions(base: DataFrame) -> DataFrame:
    """form_id, field_key, old, new, flag, in_old, in_new: the widths of each field in the two versions, aligned by key. In the
    second version of a form, type 4 is removed, type 7 is under another key, and required fields are one wider.

    Every field is dealt once, as a row of the old and one of the new version; grouping by key within a form needs no exchange
    beyond that of the form. flag is that of the new version. The key that a field of type 7 gets may be another field's: the new
    version then has two fields of one key, and each is a row beside the old one."""
    moved = F.coalesce(F.col("type_code") == 7, F.lit(False))
    width = F.when(F.col("required"), F.col("width") + 1).otherwise(F.col("width"))
    side = lambda k, w, turn: F.struct(k.alias("field_key"), w.alias("width"), turn.alias("turn"))
    old = side(F.col("field_key"), F.col("width"), F.lit(0))
    new = side(F.when(moved, F.col("field_key") + 1000000).otherwise(F.col("field_key")), width, F.when(moved, 2).otherwise(1))
    rows = base.select("form_id", "flag", F.explode(F.when(F.col("type_code") != 4, F.array(old, new)).otherwise(F.array(old))).alias("s")).select("form_id", "flag", "s.*")
    # A version has a key once as its own and once as a moved one, no more.
    of = lambda turn: F.max(F.when(F.col("turn") == turn, F.struct("width", "flag")))
    met = rows.groupBy("form_id", "field_key").agg(of(0).alias("o"), of(1).alias("own"), of(2).alias("moved"))
    each = met.select("form_id", "field_key", "o", F.explode_outer(F.array_compact(F.array("own", "moved"))).alias("n"))
    return each.select("form_id", "field_key", F.col("o.width").alias("old"), F.col("n.width").alias("new"), F.col("n.flag").alias("flag"), F.col("o").isNotNull().alias("in_old"), F.col("n").isNotNull().alias("in_new"))


@query("field_catalog", f"with {FIELDS_SQL} select form_id, string_agg('#' || pos || ' ' || field_key || ' | ' || type_code || ' | ' || case when required then 'required' else 'optional' end, chr(10) order by pos) as catalog from fields group by form_id")
def field_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-01: a line per field; a form's fields fit one row by definition."""
    line = F.format_string("#%d %d | %d | %s", "pos", "field_key", "type_code", F.when(F.col("required"), "required").otherwise("optional"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    return form_fields(spark, sf_dir).groupBy("form_id").agg(F.array_join(lines, "\n").alias("catalog"))


@query("dedupe_fields", f"with {BASE_SQL} select form_id, pos, field_key from base")
def dedupe_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-03."""
    return base_fields(spark, sf_dir).select("form_id", "pos", "field_key")


@query("postprocess", f"with {BASE_SQL} select b.form_id, b.pos, b.field_key, b.required::int as required, '$form' || b.form_id || '$' as form_title from base b")
def postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-02 to J-05, I-18 on typed documents."""
    title = F.concat(F.lit("$form"), F.col("form_id").cast("string"), F.lit("$"))
    return base_fields(spark, sf_dir).select("form_id", "pos", "field_key", F.col("required").cast("int").alias("required"), title.alias("form_title"))


@query("schema_projection", f"with {FIELDS_SQL} select form_id, pos, field_key, width from fields")
def schema_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-06: columns that are not allowed are never read from the scan's output."""
    allowed = {"form_id", "pos", "field_key", "width", "no_such_column"}
    fields = form_fields(spark, sf_dir)
    return fields.select(*[c for c in fields.columns if c in allowed])


@query("strip_keys", f"with {FIELDS_SQL} select form_id, pos, field_key, required, width from fields")
def strip_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-07."""
    return form_fields(spark, sf_dir).drop("flag", "type_code", "no_such_column")


@query("apply_update_field", f"with {BASE_SQL} select form_id, pos, field_key, case when type_code = 2 then 99 else width end as width from base")
def apply_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-09: a patch merges into the fields it names and never renames them."""
    patch = F.when(F.col("type_code") == 2, F.lit(99)).otherwise(F.col("width"))
    return base_fields(spark, sf_dir).select("form_id", "pos", "field_key", patch.cast("long").alias("width"))


@query("apply_add_field", f"with {BASE_SQL}, a as (select form_id, -form_id as field_key, min(pos) as after from base where required group by form_id) select form_id, field_key, row_number() over (partition by form_id order by spot) as pos from (select form_id, field_key, pos::double as spot from base union all select form_id, field_key, after + 0.5 from a)")
def apply_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10: one new field after the first required one; positions are dealt anew."""
    first = F.min(F.when(F.col("required"), F.col("pos"))).over(Window.partitionBy("form_id"))
    spot = lambda k, at: F.struct(k.alias("field_key"), at.alias("at"))
    own, added = spot(F.col("field_key"), F.col("pos").cast("double")), F.when(F.col("pos") == F.col("first"), spot(-F.col("form_id"), F.col("pos") + 0.5))
    every = base_fields(spark, sf_dir).withColumn("first", first).select("form_id", F.explode(F.array_compact(F.array(own, added))).alias("s")).select("form_id", "s.*")
    return every.select("form_id", "field_key", F.row_number().over(Window.partitionBy("form_id").orderBy("at")).cast("long").alias("pos"))


@query("apply_remove_field", f"with {BASE_SQL} select form_id, pos, field_key from base where flag <> 'F'")
def apply_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-11."""
    return base_fields(spark, sf_dir).where("flag <> 'F'").select("form_id", "pos", "field_key")


_FORM_PATCH = {1: "title", 2: "columns", 3: "state", 4: "owner", 5: "id"}


@query("apply_update_form", f"""with {BASE_SQL}, p as (select form_id, max(case when type_code = 1 then 't' || width end) as title, max(case when type_code = 2 then 't' || width end) as columns,
  string_agg(distinct case type_code when 4 then 'owner' when 5 then 'id' end, ',' order by case type_code when 4 then 'owner' when 5 then 'id' end) as illegal from base group by form_id)
select form_id, case when illegal is null then coalesce(title, 'untitled') else 'untitled' end as title, case when illegal is null then coalesce(columns, 'none') else 'none' end as columns, coalesce(illegal, '') as illegal from p""")
def apply_update_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-12, H-02: a patch with keys that are not on the list is rejected whole, and the keys are told. A form's patch sets what its
    types of fields name, to the widest."""
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in _FORM_PATCH.items() for x in kv]), F.col("type_code"))
    said = base_fields(spark, sf_dir).groupBy("form_id", name.alias("k")).agg(F.max(F.concat(F.lit("t"), F.col("width").cast("string"))).alias("v"))
    patch = F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))
    forms = said.groupBy("form_id").agg(patch.alias("patch"))
    illegal = F.array_sort(F.array_except(F.map_keys("patch"), F.array(F.lit("title"), F.lit("columns"), F.lit("state"))))
    after = lambda k, default: F.coalesce(F.when(F.size(illegal) == 0, F.try_element_at("patch", F.lit(k))), F.lit(default)).alias(k)
    return forms.select("form_id", after("title", "untitled"), after("columns", "none"), F.array_join(illegal, ",").alias("illegal"))


@query("apply_update_button", f"""with {BASE_SQL}, b as (select form_id, pos, 'b' || (width % 7) as name, flag = 'O' as top, row_number() over (partition by form_id order by flag <> 'O', pos) as place from base),
w as (select form_id, 'b' || (max(width) filter (where type_code < 5) % 7) as wanted from base group by form_id)
select w.form_id, wanted, case when arg_min(top, place) then 'top' when not arg_min(top, place) then 'bottom' end as part, arg_min(pos, place) as pos from w left join b on b.form_id = w.form_id and b.name = w.wanted group by w.form_id, wanted""")
def apply_update_button(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-13, G-05: the first button of the name, top before bottom; none if the form has no such button. Fields stand for buttons."""
    button = F.struct((F.col("flag") != "O").alias("low"), "pos", F.concat(F.lit("b"), (F.col("width") % 7).cast("string")).alias("name"))
    wanted = F.concat(F.lit("b"), (F.max(F.when(F.col("type_code") < 5, F.col("width"))) % 7).cast("string"))
    forms = base_fields(spark, sf_dir).groupBy("form_id").agg(F.array_sort(F.collect_list(button)).alias("buttons"), wanted.alias("wanted"))
    hit = F.try_element_at(F.filter("buttons", lambda b: b["name"] == F.col("wanted")), F.lit(1))
    return forms.withColumn("hit", hit).select("form_id", "wanted", F.when(F.col("hit.low"), "bottom").when(~F.col("hit.low"), "top").alias("part"), F.col("hit.pos").alias("pos"))


@query("apply_batch_atomic", f"""with {BASE_SQL}, ops as (select form_id, pos as n, case type_code when 1 then 'remove' when 2 then 'update' when 3 then 'add' else 'none' end as op, case when type_code = 3 and not required then field_key else field_key end as k, required from base),
f as (select form_id, count(case when op = 'add' and not required then 1 end) as failures, count(case when op = 'update' then 1 end) as updates, count(case when op = 'remove' then 1 end) as removes, count(case when op = 'add' and required then 1 end) as adds, count(*) as n from ops group by form_id)
select form_id, failures = 0 as ok, failures, case when failures = 0 then n - removes + adds else n end as n_fields, case when failures = 0 then updates else 0 end as n_updated from f""")
def apply_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-14, J-16: a form's ops in order on one draft, all failures listed, all or nothing.

    Type 1 fields are removed, type 2 widened, and for type 3 a field is added, under a taken key unless it is required."""
    fields = base_fields(spark, sf_dir)
    kind = F.when(F.col("type_code") == 1, "remove").when(F.col("type_code") == 2, "update").when(F.col("type_code") == 3, "add").otherwise("none")
    op = F.struct("pos", kind.alias("op"), F.when((F.col("type_code") == 3) & F.col("required"), -1 - F.col("field_key")).otherwise(F.col("field_key")).alias("key"))
    docs = fields.groupBy("form_id").agg(F.array_sort(F.collect_list(op)).alias("ops"), F.collect_list("field_key").alias("keys"))
    zero = F.struct(F.col("keys").alias("keys"), F.lit(0).alias("failures"), F.lit(0).alias("updated"))

    def step(state: F.Column, o: F.Column) -> F.Column:
        there = F.array_contains(state["keys"], o["key"])
        fails = ((o["op"] == "add") & there) | (o["op"].isin("remove", "update") & ~there)
        keys = F.when(fails, state["keys"]).when(o["op"] == "remove", F.array_remove(state["keys"], o["key"])).when(o["op"] == "add", F.array_append(state["keys"], o["key"])).otherwise(state["keys"])
        return F.struct(keys.alias("keys"), (state["failures"] + fails.cast("int")).alias("failures"), (state["updated"] + (~fails & (o["op"] == "update")).cast("int")).alias("updated"))

    done = docs.withColumn("s", F.aggregate("ops", zero, step))
    ok = F.col("s.failures") == 0
    return done.select("form_id", ok.alias("ok"), F.col("s.failures").cast("long").alias("failures"), F.when(ok, F.size("s.keys")).otherwise(F.size("keys")).cast("long").alias("n_fields"), F.when(ok, F.col("s.updated")).otherwise(0).cast("long").alias("n_updated"))


@query("restore_untouched", f"with {BASE_SQL}, {_NEW_SQL} select n.form_id, n.field_key, case when n.flag = 'O' then n.width else coalesce(b.width, n.width) end as width from new n left join base b on b.form_id = n.form_id and b.field_key = n.field_key")
def restore_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-17, D-05: fields that no op touched (flag other than O) are as in the baseline."""
    both = both_versions(base_fields(spark, sf_dir)).where("in_new")
    return both.select("form_id", "field_key", F.when(F.col("flag") == "O", F.col("new")).otherwise(F.coalesce("old", "new")).alias("width"))


@query("continuation_rule", f"with {BASE_SQL}, {_NEW_SQL}, o as (select b.form_id, count(n.field_key) as shared from base b left join new n on n.form_id = b.form_id and n.field_key = b.field_key group by b.form_id), s as (select form_id, count(*) as n from new group by form_id) select o.form_id, o.shared > 0 or s.n is null as continues from o left join s on s.form_id = o.form_id")
def continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-28, D-12: the identity is kept if a field key is, or if nothing is left."""
    by = both_versions(base_fields(spark, sf_dir)).groupBy("form_id").agg(F.bool_or(F.col("in_old") & F.col("in_new")).alias("shared"), F.bool_or("in_new").alias("left"))
    return by.select("form_id", (F.col("shared") | ~F.col("left")).alias("continues"))


@query("fill_missing_required", f"""with {BASE_SQL}, sib as (select form_id, type_code, width, pos, row_number() over (partition by form_id, type_code order by pos) as k from base where width % 2 = 0)
select b.form_id, b.field_key, coalesce(case when b.width % 2 = 0 then b.width end, s.width, case when b.type_code <= 3 then 10 * b.type_code end, case when b.type_code <= 5 then 2 end) as width,
  b.width % 2 <> 0 and coalesce(s.width, case when b.type_code <= 3 then 10 * b.type_code end, case when b.type_code <= 5 then 2 end) is not null as changed
from base b left join sib s on s.form_id = b.form_id and s.type_code = b.type_code and s.k = 1""")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-08, D-09, D-10: an odd width counts as missing; sibling of the type, template, default, else unchanged (null)."""
    same = Window.partitionBy("form_id", "type_code")
    sibling = F.min_by("width", F.when(F.col("width") % 2 == 0, F.col("pos"))).over(same)
    base = base_fields(spark, sf_dir).withColumn("sibling", sibling)
    dims = spark.createDataFrame([(1, 10, 2), (2, 20, 2), (3, 30, 2), (4, None, 2), (5, None, 2)], "type_code int, template long, default_width long")
    have = F.when(F.col("width") % 2 == 0, F.col("width"))
    found = F.coalesce("sibling", "template", "default_width")
    joined = base.join(F.broadcast(dims), "type_code", "left")  # five rows
    return joined.select("form_id", "field_key", F.coalesce(have, found).alias("width"), (have.isNull() & found.isNotNull()).alias("changed"))


_DIFF_SQL = f"""{BASE_SQL}, {_NEW_SQL}, d as (select coalesce(b.form_id, n.form_id) as form_id, coalesce(b.field_key, n.field_key) as field_key,
  case when n.field_key is null then 'remove' when b.field_key is null then 'add' else 'modify' end as kind, b.width as old, n.width as new
  from base b full outer join new n on b.form_id = n.form_id and b.field_key = n.field_key where b.width is distinct from n.width)"""


@query("doc_diff_by_identity", f"with {_DIFF_SQL} select * from d")
def diff_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-19, D-03, H-04: changes of fields aligned by key."""
    both = both_versions(base_fields(spark, sf_dir)).where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("form_id", "field_key", F.when(~F.col("in_new"), "remove").when(~F.col("in_old"), "add").otherwise("modify").alias("kind"), "old", "new")


@query("doc_diff_positional", f"with {BASE_SQL}, {_NEW_SQL}, a as (select *, row_number() over (partition by form_id order by pos) as i from base), b as (select *, row_number() over (partition by form_id order by pos) as i from new) select coalesce(a.form_id, b.form_id) as form_id, coalesce(a.i, b.i) as i, case when a.i is null then 'add' else 'modify' end as kind, a.field_key as old, b.field_key as new from a full outer join b on a.form_id = b.form_id and a.i = b.i where a.field_key is distinct from b.field_key")
def diff_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-04: without a key, elements are aligned by place; extra old elements are modified to nothing."""
    by = Window.partitionBy("form_id").orderBy("pos")
    there = F.col("type_code") != 4
    key = F.when(F.col("type_code") == 7, F.col("field_key") + 1000000).otherwise(F.col("field_key"))
    placed = base_fields(spark, sf_dir).withColumn("i", F.row_number().over(by).cast("long")).withColumn("j", F.sum(there.cast("long")).over(by))
    side = lambda i, k, new: F.struct(F.col(i).alias("i"), k.alias("k"), F.lit(new).alias("is_new"))
    sides = F.array_compact(F.array(side("i", F.col("field_key"), False), F.when(there, side("j", key, True))))
    rows = placed.select("form_id", F.explode(sides).alias("s")).select("form_id", "s.*")
    of = lambda new: F.max(F.when(F.col("is_new") == new, F.col("k")))
    both = rows.groupBy("form_id", "i").agg(of(False).alias("old"), of(True).alias("new"))
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("form_id", "i", F.when(F.col("old").isNull(), "add").otherwise("modify").alias("kind"), "old", "new")


@query("diff_summary", f"with {_DIFF_SQL}, r as (select *, row_number() over (partition by form_id, kind order by field_key) as k, count(*) over (partition by form_id, kind) as n from d) select form_id, kind, string_agg(field_key::varchar, ', ' order by field_key) || case when max(n) > 3 then ' 等' else '' end as summary, max(n) as n from r where k <= 3 group by form_id, kind")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-20, E-05, E-06: the first three changes of each kind."""
    grouped = diff_by_identity(spark, sf_dir).groupBy("form_id", "kind").agg(F.array_sort(F.collect_list("field_key")).alias("keys"))
    first = F.array_join(F.slice(F.col("keys").cast("array<string>"), 1, 3), ", ")
    return grouped.select("form_id", "kind", F.concat(first, F.when(F.size("keys") > 3, " 等").otherwise("")).alias("summary"), F.size("keys").cast("long").alias("n"))


def _page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("html", "\n")
    changed = F.array_join(F.transform(F.filter(lines, lambda s, i: i % 7 != 3), lambda s, i: F.when(i % 5 == 2, F.concat(s, F.lit("!"))).otherwise(s)), "\n")
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("old"), changed.alias("new"))


@query("line_diff")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-21, J-22, F-09: the rows of the diff of two versions of each page."""
    linediff.bound_batches(spark)
    diffed = _page_pairs(spark, sf_dir).select("page_id", F.posexplode(linediff.line_diff(F.col("old"), F.col("new"))).alias("line", "d"))
    return diffed.select("page_id", "line", "d.type", "d.old_no", "d.new_no", "d.text")


@query("line_diff_counts")
def line_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-04."""
    linediff.bound_batches(spark)
    d = _page_pairs(spark, sf_dir).select("page_id", linediff.line_counts(F.col("old"), F.col("new")).alias("d"))
    return d.select("page_id", "d.added", "d.removed")


@query("open_documents_batch")
def open_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-16, J-17, J-02 to J-05 on open documents: ops as JSON, one document a form, unknown keys kept."""
    field = F.struct(F.col("field_key").cast("string").alias(O.KEY), F.format_string("field %d", "pos").alias(O.TITLE), F.col("type_code").alias(O.TYPE), F.col("required").alias("isRequiredField"), F.lit("x").alias("icon"))
    docs = form_fields(spark, sf_dir).groupBy("form_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(field)).alias(O.FIELDS))).alias("doc"), F.min("field_key").cast("string").alias("k"))
    ops = json.dumps([{"op": "update_field", "key": "KEY", "patch": {O.TITLE: "patched", O.KEY: "ignored"}}, {"op": "add_field", "field": {O.KEY: "new", O.TYPE: 1}, "after": "KEY"}])
    result = O.on_json(lambda doc, ops: O.apply_ops(O.postprocess(doc), ops))(F.col("doc"), F.regexp_replace(F.lit(ops), "KEY", F.col("k")))
    return docs.select("form_id", result.alias("result"))


@query("template_resolution", "with dim(type_code, type_name, stem) as (values (1, 'Text', null), (2, 'Select', 'select_v2'), (3, 'Date', null), (4, 'File', null)) select l_orderkey as form_id, l_linenumber as type_code, coalesce(stem, lower(type_name)) || '.json' as template, count(*) as n from lineitem left join dim on type_code = l_linenumber group by 1, 2, 3")
def template_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-07, D-08, E-07, I-13, J-29: type code to template name; an unknown type has none."""
    dim = spark.createDataFrame([(1, "Text", None), (2, "Select", "select_v2"), (3, "Date", None), (4, "File", None)], "type_code int, type_name string, stem string")
    fields = form_fields(spark, sf_dir).select("form_id", "type_code")
    joined = fields.join(F.broadcast(dim), "type_code", "left")  # four rows
    return joined.groupBy("form_id", "type_code", F.concat(F.coalesce("stem", F.lower("type_name")), F.lit(".json")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query("data_card", "select o_orderkey as form_id, string_agg(k || '=' || v, ', ' order by i) as card from (select o_orderkey, unnest([1, 2, 3, 4]) as i, unnest(['Status', 'o_custkey', 'o_orderpriority', 'empty']) as k, unnest([o_orderstatus, o_custkey::varchar, o_orderpriority, '']) as v from orders) where v <> '' and i <= 6 group by o_orderkey")
def data_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-10, D-16: up to six non-empty values under their labels."""
    labels = F.create_map(F.lit("o_orderstatus"), F.lit("Status"))
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), (F.col(c).cast("string") if c != "empty" else F.lit("")).alias("v")) for c in ("o_orderstatus", "o_custkey", "o_orderpriority", "empty")])
    shown = F.slice(F.filter(pairs, lambda p: F.coalesce(p["v"], F.lit("")) != ""), 1, 6)
    text = F.array_join(F.transform(shown, lambda p: F.concat(F.coalesce(F.try_element_at(labels, p["k"]), p["k"]), F.lit("="), p["v"])), ", ")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("form_id"), text.alias("card"))


@query("result_view", f"with {FIELDS_SQL} select form_id, count(*) as field_count, string_agg(case when pos <= 10 then 'f' || field_key end, ', ' order by pos) || case when count(*) > 10 then '... 共 ' || count(*) || ' 个字段' else '' end as names from fields group by form_id")
def result_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-11, E-09: field count and the first ten names."""
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "field_key"))), 1, 10), lambda x: F.concat(F.lit("f"), x["field_key"].cast("string")))
    n = F.count(F.lit(1))
    tail = F.when(n > 10, F.concat(F.lit("... 共 "), n.cast("string"), F.lit(" 个字段"))).otherwise("")
    return form_fields(spark, sf_dir).groupBy("form_id").agg(n.alias("field_count"), F.concat(F.array_join(names, ", "), tail).alias("names"))
