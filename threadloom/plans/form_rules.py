"""Open form documents in columns and joins: catalog, copies, repair in rounds; the same documents as plans/open_docs has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import form_columns as C, open_documents as O, repair as R
from ..sources.tables import first_of_each_key, form_fields, table
from . import open_docs
from .base import SQL, query


@query("catalog_columns", SQL["document_catalog"])
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-01: the catalog of each form as one column expression."""
    docs = open_docs._form_docs(spark, sf_dir).withColumn("v", F.parse_json("doc")).withColumn("c", C.catalog(F.col("v"), open_docs._NAMES))
    return docs.select("form_id", F.col("c.text").alias("catalog"), F.array_join("c.keys", ",").alias("keys"))


@query("cloned_columns", """select o_orderkey as form_id, to_json({'formCode': case when o_orderkey % 3 = 0 then 'given' when o_orderstatus = 'P' then '_copy' else 'form' || o_orderkey || '_copy' end,
  'formName': case when o_orderstatus = 'F' then 'copy for ' || o_custkey else o_orderpriority || '(副本)' end, 'keep': 1})::varchar as doc from orders""")
def cloned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-17, J-23: copies with a given code, a given name, both or neither; some sources have no code."""
    code = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("form"), F.col("o_orderkey").cast("string")))
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("id"), code.alias("formCode"), F.col("o_orderpriority").alias("formName"), F.lit("t").alias("createTime"), F.lit("u").alias("updateBy"), F.lit(1).alias("keep")))
    given, name = F.when(F.col("o_orderkey") % 3 == 0, "given"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("copy for "), F.col("o_custkey").cast("string"))).otherwise("")
    docs = table(spark, sf_dir, "orders").withColumn("doc", F.parse_json(doc))
    return docs.select(F.col("o_orderkey").alias("form_id"), C.cloned(F.col("doc"), name, given).alias("doc"))


@query("repaired_tree", f"""select form_id, rounds, n_errors, case when form_id % 3 = 0 then 0 else n_errors end as n_new, n_styles, modes from ({SQL['validate_repair']})""")
def repaired_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-25 to J-27, J-08, D-10: the documents of `validate_repair`, each repaired in joins, one per round; every third is compared
    with itself, the others with a document without fields."""
    mode = F.when(F.col("type_code").isin(2, 3) & F.col("required"), F.col("width") % 3)
    field = F.struct(F.concat(F.lit("k"), F.col("field_key").cast("string")).alias(O.KEY), F.col("type_code").alias(O.TYPE), mode.alias("selectMode"), F.when(F.col("type_code") == 4, 0).alias("displayStyle"), F.lit("m").alias("mainTable"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", field.alias("f")))), lambda x: x["f"])
    by = first_of_each_key(form_fields(spark, sf_dir)).groupBy("form_id").agg(listed.alias(O.FIELDS))
    doc = F.to_json(F.struct(F.lit("f").alias("formName"), F.when(F.col("form_id") % 2 == 0, "x").alias("icon"), F.col(O.FIELDS)))
    docs = by.select("form_id", F.parse_json(doc).alias("doc"))
    base = F.when(F.col("form_id") % 3 == 0, F.col("doc")).otherwise(F.parse_json(F.lit('{"formName":"f"}')))
    done = R.repaired(docs.withColumn("base", base), "doc", ["form_id"], open_docs._RULES, "base")
    fields = F.from_json("doc", f"struct<{O.FIELDS}:array<struct<selectMode:bigint,displayStyle:bigint>>>")[O.FIELDS]
    modes = F.filter(F.transform(fields, lambda f: f["selectMode"]), lambda m: m.isNotNull())
    styles = F.size(F.filter(fields, lambda f: f["displayStyle"] == 1)).cast("long")
    total = F.when(F.size(modes) > 0, F.aggregate(modes, F.lit(0).cast("long"), lambda a, x: a + x))
    return done.select("form_id", "rounds", F.size("errors").cast("long").alias("n_errors"), F.size("new_errors").cast("long").alias("n_new"), styles.alias("n_styles"), total.alias("modes"))
