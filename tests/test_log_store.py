import datetime

from pyspark.sql import functions as F

from threadloom.sources import log_store as L


def at(s):
    return datetime.datetime(2024, 1, 1, 0, 0, s)


def test_sessions_over_appends(spark, tmp_path):
    path = str(tmp_path / "store")
    new = spark.createDataFrame([(1, 7, "ctx", "First", at(0)), (2, 8, "ctx", "Second", at(1))], "conv_id long, user_id long, context_key string, title string, created_at timestamp")
    L.append(spark, path, *L.created(new))
    messages = spark.createDataFrame([(1, 1, "user", "hello", None, at(5)), (1, 2, "tool", "done", "{\"a\":1}", at(6))], "conv_id long, seq long, role string, content string, config_snapshot string, created_at timestamp")
    events = L.message_events(messages)
    L.append(spark, path, events, L.touched_by(events))
    set_ = spark.createDataFrame([(1, at(7), "x", "cfg1", ""), (1, at(8), "y", "cfg2", "Renamed"), (2, at(9), "z", "cfg3", None)], "conv_id long, at timestamp, id string, config string, title string")
    L.append(spark, path, meta=L.configured(set_))
    keyed = spark.createDataFrame([(2, at(10), "k")], "conv_id long, at timestamp, id string")
    L.append(spark, path, meta=L.changes(keyed, context_key=F.lit("moved")), calls=spark.createDataFrame([("c1", 1, "llm", 0.5, "{}", None, at(3))], L.CALLS))
    model = {r.conv_id: (r.user_id, r.context_key, r.title, r.current_config, r.updated_at) for r in L.read_model(spark.read.parquet(f"{path}/changes")).collect()}
    assert model == {1: (7, "ctx", "Renamed", "cfg2", at(8)), 2: (8, "moved", "Second", "cfg3", at(10))}
    log = spark.read.parquet(f"{path}/events").orderBy("created_at").collect()
    assert [(r.conv_id, r.kind) for r in log] == [(1, "checkpoint"), (2, "checkpoint"), (1, "user"), (1, "assistant")]
    assert log[2].payload == '{"role":"user","content":"hello","config_snapshot":null}'
    assert spark.read.parquet(f"{path}/calls").count() == 1


def test_ids_are_the_same_when_a_batch_runs_again(spark):
    rows = [(1, k, "user", "x", None, at(0)) for k in range(5)]
    ids = [sorted(r.id for r in L.message_events(spark.createDataFrame(rows, "conv_id long, seq long, role string, content string, config_snapshot string, created_at timestamp")).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 5
