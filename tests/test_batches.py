"""Batches that are whole or absent, lookups that open few files, files of several schemas."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from threadloom.sources import batches as B, log_store as L, migrations as M


def sessions(spark, ids):
    return spark.createDataFrame([(k, k * 10, "ctx", "T", datetime.datetime(2024, 1, 1)) for k in ids], "conv_id long, user_id long, context_key string, title string, created_at timestamp")


def test_a_failed_batch_leaves_no_half_session(spark, tmp_path):
    path = str(tmp_path / "store")
    events, changes = L.created(sessions(spark, range(20)))
    broken = changes.withColumn("title", F.when(F.col("conv_id") == 13, F.raise_error(F.lit("torn"))).otherwise(F.col("title")))
    assert B.commit(spark, path, 0, events=L.created(sessions(spark, [99]))[0])
    for _ in range(2):
        with pytest.raises(Exception, match="torn"):
            B.commit(spark, path, 1, events=events, changes=broken)
        assert sorted(os.listdir(path)) == [".batch=0.crc", "batch=0"] or sorted(os.listdir(path)) == ["batch=0"]
    assert B.table(spark, path, "events").count() == 1 and B.table(spark, path, "changes").count() == 0
    assert B.commit(spark, path, 1, events=events, changes=changes)
    assert not B.commit(spark, path, 1, events=events, changes=changes)  # runs again
    assert not B.commit(spark, path, 1, events=events.limit(1))
    assert {n: B.table(spark, path, n).count() for n in B.TABLES} == {"events": 21, "changes": 20, "calls": 0}
    assert {r["conv_id"] for r in L.read_model(B.table(spark, path, "changes")).collect()} == set(range(20))


def test_a_stream_of_batches_is_added_once(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "store")
    for k in range(3):
        sessions(spark, [k]).coalesce(1).write.mode("append").parquet(src)
    for checkpoint in ("a", "b"):  # the second one starts anew: same numbers, same batches
        stream = spark.readStream.schema(sessions(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(src)
        save = lambda rows, number: B.commit(spark, path, number, **dict(zip(("events", "changes"), L.created(rows))))
        stream.writeStream.foreachBatch(lambda rows, number: save(rows, number) and None).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(120)
    assert B.table(spark, path, "events").count() == B.table(spark, path, "changes").count() == 3


def scanned(df):
    """(files, rows) that the scan of a collected frame read."""
    rows = df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], {}
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            found = {k: metrics.apply(k).value() for k in ("numFiles", "numOutputRows")}
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return rows, found


def test_a_lookup_opens_a_bounded_share_of_the_files(spark, tmp_path):
    path = str(tmp_path / "store")
    for batch in range(3):
        events = spark.range(20_000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 1000).alias("conv_id"), F.lit(batch).cast("long").alias("seq"), F.lit("user").alias("kind"), F.lit("{}").alias("payload"), F.timestamp_seconds("id").alias("created_at"))
        assert B.commit(spark, path, batch, shelves=16, events=events, calls=spark.createDataFrame([("c", None, "llm", 1.0, None, None, None)], L.CALLS))
    _, whole = scanned(B.table(spark, path, "events"))
    rows, one = scanned(B.lookup(spark, path, "events", [123], shelves=16))
    assert len(rows) == 60 and {r["conv_id"] for r in rows} == {123}
    assert one["numFiles"] * 8 <= whole["numFiles"] and one["numOutputRows"] * 8 <= whole["numOutputRows"] == 60_000
    assert B.lookup(spark, path, "events", [5, 700, 5000], shelves=16).count() == 120
    assert B.lookup(spark, path, "events", []).count() == 0
    plan = B.lookup(spark, path, "events", [123], shelves=16)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "In(conv_id" in plan.replace("EqualTo(conv_id", "In(conv_id")
    assert [r["call_type"] for r in B.table(spark, path, "calls").collect()] == ["llm"] * 3


def test_a_full_shelf_is_split_over_tasks(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        events = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("seq"), F.lit("user").alias("kind"), F.sha2(F.col("id").cast("string"), 512).alias("payload"), F.timestamp_seconds("id").alias("created_at"))
        B.commit(spark, path, 0, events=events)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    rows, one = scanned(B.lookup(spark, path, "events", [7]))
    assert len(rows) == 60_000 and one["numFiles"] > 3


def test_three_schemas_are_one_table(spark, tmp_path):
    path = str(tmp_path / "sessions")
    spark.createDataFrame([(1, 10, "f")], "conv_id long, user_id long, form_code string").write.parquet(f"{path}/version=1")
    spark.createDataFrame([(2, "u", "c")], "conv_id long, user_id string, context_key string").write.parquet(f"{path}/version=2")
    spark.createDataFrame([(3, "v", "d", "sum", "{}")], "conv_id long, user_id string, context_key string, summary string, current_config string").write.parquet(f"{path}/version=3")
    spark.createDataFrame([(4, "w", "half", None)], "conv_id long, user_id string, form_code string, context_key string").write.mode("append").parquet(f"{path}/version=1")
    spark.createDataFrame([(5, "x", "e", "early")], "conv_id long, user_id string, context_key string, summary string").write.mode("append").parquet(f"{path}/version=2")
    columns = ["conv_id", "user_id", "context_key", "summary", "current_config"]
    with pytest.raises(Exception):  # one column with two types under one version is no version
        M.read(spark, path, M.SESSION_STEPS, columns).collect()


@pytest.mark.parametrize("versions", [(1, 2, 3), (2,), (3, 1)])
def test_versions_by_steps(spark, tmp_path, versions):
    path = str(tmp_path / "sessions")
    files = {1: ([(1, 10, "f", None), (4, 40, "old", "new")], "conv_id long, user_id long, form_code string, context_key string"), 2: ([(2, "u", "c")], "conv_id long, user_id string, context_key string"), 3: ([(3, "v", "d", "sum", "{}")], "conv_id long, user_id string, context_key string, summary string, current_config string")}
    want = {1: [(1, "10", "f", "", None, 1), (4, "40", "new", "", None, 1)], 2: [(2, "u", "c", "", None, 2)], 3: [(3, "v", "d", "sum", "{}", 3)]}
    for v in versions:
        spark.createDataFrame(*files[v]).write.parquet(f"{path}/version={v}")
    columns = ["conv_id", "user_id", "context_key", "summary", "current_config"]
    found = M.read(spark, path, M.SESSION_STEPS, columns)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((r for v in versions for r in want[v]), key=repr)
    if 2 in versions:
        assert "PushedFilters: [IsNotNull(context_key), EqualTo(context_key,c)]" in found.where("context_key = 'c'")._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="unknown"):
        M.upgraded(found, 4, M.SESSION_STEPS)
