"""A document is read in one pass; texts are quoted without VARIANT."""

from pyspark.sql import functions as F

from threadloom.operators import form_columns as C, variants as V


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_the_catalog_reads_a_document_in_one_pass(spark):
    docs = spark.range(1).select(F.parse_json(F.lit("{}")).alias("d"))
    assert plan(docs.select(C.catalog(F.col("d")).alias("c"))).count("try_variant_get(") <= 2  # the document, and a field's options


def test_texts_are_quoted_as_variant_quotes_them(spark):
    odd = ["", "a", '"\\/', "\n\t\b\x01\x7f", "\u2028é汉😀", "]", None]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(V.quoted(F.col("t")).alias("q"), F.to_json(F.col("t").cast("variant")).alias("v")).collect()
    assert [r["q"] for r in rows] == [r["v"] for r in rows]
