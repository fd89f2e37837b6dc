"""Tables of the engine, read from Parquet with only the columns that a query names.

The driver's tables stand in for the engine's own: conversations for the event log, orders for the session read model and form
headers, lineitem for form fields, events for the call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, seq, kind, content: an append-only log, ordered by seq within a conversation."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("role").alias("kind"), F.col("text").alias("content"))


def session_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, user_id, context_key, title, updated_at: the read model, one row per session."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conv_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("context_key"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("title"), F.col("o_orderdate").alias("updated_at"))


META_SQL = "meta as (select o_orderkey as conv_id, o_custkey as user_id, o_orderstatus as context_key, case when o_orderpriority = '5-LOW' then '' else o_orderpriority end as title, o_orderdate as updated_at from orders)"


def call_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, conv_id, call_type, duration, request, created_at."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("conv_id"), F.col("event_type").alias("call_type"), F.col("value").alias("duration"), F.col("props").alias("request"), F.col("ts").alias("created_at"))


CALLS_SQL = "calls as (select event_id as id, user_id as conv_id, event_type as call_type, value as duration, props as request, ts as created_at from events)"

_LINE = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """form_id, pos, field_key, type_code, required, width, flag: the fields of each form in order, one row each."""
    # Named before they are dealt, so that what follows knows that a form's fields are together already.
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("form_id"), *_LINE)
    pos = F.row_number().over(Window.partitionBy("form_id").orderBy(*_LINE))
    return lines.select("form_id", pos.cast("long").alias("pos"), F.col("l_partkey").alias("field_key"), F.col("l_linenumber").alias("type_code"), (F.col("l_returnflag") == "R").alias("required"), F.col("l_quantity").cast("long").alias("width"), F.col("l_linestatus").alias("flag"))


FIELDS_SQL = f"fields as (select l_orderkey as form_id, row_number() over (partition by l_orderkey order by {', '.join(_LINE)}) as pos, l_partkey as field_key, l_linenumber as type_code, l_returnflag = 'R' as required, l_quantity::bigint as width, l_linestatus as flag from lineitem)"


def first_of_each_key(fields: DataFrame) -> DataFrame:
    """Fields without later repeats of a key within a form; positions are kept."""
    again = F.row_number().over(Window.partitionBy("form_id", "field_key").orderBy("pos"))
    return fields.withColumn("again", again).where("again = 1").drop("again")


BASE_SQL = FIELDS_SQL + ", base as (select * from (select *, row_number() over (partition by form_id, field_key order by pos) as again from fields) where again = 1)"
