"""Silence, questions and stale writes: timers that fire without input, restarts from one checkpoint, writers with one base."""

import json
import time
from collections import Counter

import pytest

from threadloom.streaming import keyed as K


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", K.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, path, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def test_a_silent_stream_is_kept_alive(spark, tmp_path):
    schema, path = "stream string, kind string, frame string", str(tmp_path / "in")
    put(spark, path, schema, [("silent", "token", "a"), ("over", "token", "b"), ("over", "end", "")])
    alive = K.kept_alive(source(spark, path, schema, 10), quiet_s=2, beat_s=3)
    q = alive.writeStream.format("memory").queryName("alive").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        until = time.time() + 90
        while time.time() < until:
            kinds = Counter(r["kind"] for r in spark.table("alive").where("stream = 'silent'").collect())
            if kinds["keepalive"] >= 3 and kinds["ping"] >= 2:
                break
            time.sleep(0.5)
        put(spark, path, schema, [("silent", "end", "")])
        while time.time() < until and not spark.table("alive").where("stream = 'silent' and kind = 'end'").count():
            time.sleep(0.5)
        ended = spark.table("alive").count()
        time.sleep(5)
        rows = spark.table("alive").orderBy("at_ms").collect()
    finally:
        q.stop()
    assert len(rows) == ended  # nothing more after the end
    silent = [r for r in rows if r["stream"] == "silent"]
    assert {r["kind"]: r["frame"] for r in silent} == {"token": "a", "keepalive": K.KEEPALIVE, "ping": K.PING, "end": ""}
    beats = [r["at_ms"] for r in silent if r["kind"] == "ping"]
    assert all(b - a >= 3000 for a, b in zip(beats, beats[1:])) and beats[0] - silent[0]["at_ms"] >= 3000
    quiet = [r["at_ms"] for r in silent if r["kind"] in ("token", "keepalive")]
    assert all(b - a >= 2000 for a, b in zip(quiet, quiet[1:]))
    assert Counter(r["kind"] for r in rows if r["stream"] == "over") == {"token": 1, "end": 1}


def upto(spark, make, path, schema, tmp_path, name, n):
    """Run until `n` rows have come out, and stop: a restart from the same checkpoint each time. (Processing time never ends by itself.)"""
    out = str(tmp_path / f"{name}-out")
    q = make(source(spark, path, schema)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(200):
            time.sleep(0.3)
            if q.exception():
                raise q.exception()
            rows = spark.read.schema(K.ASKED).parquet(out).collect() if (tmp_path / f"{name}-out" / "_spark_metadata").exists() else []
            if len(rows) >= n:
                break
    finally:
        q.stop()
    return sorted(map(tuple, rows), key=repr)


def test_a_suspended_run_outlives_two_restarts(spark, tmp_path):
    schema, path = "conv_id long, seq long, kind string, given string", str(tmp_path / "in")
    make = lambda rows: K.interrupted(rows, ("leaveType", "startDate", "endDate"))
    go = lambda n, *rows: (put(spark, path, schema, list(rows)), upto(spark, make, path, schema, tmp_path, "ask", n))[1]
    say = lambda **v: json.dumps(v)
    want = [(1, 1, "ask", "startDate,endDate"), (2, 1, "done", say(endDate="c", leaveType="a", startDate="b")), (3, 5, "ignored", None)]
    assert go(3, (1, 1, "run", say(leaveType="sick")), (2, 1, "run", say(leaveType="a", startDate="b", endDate="c")), (3, 5, "answer", '"hello"')) == sorted(want, key=repr)
    want += [(1, 2, "ask", "endDate"), (4, 1, "ask", "leaveType,startDate,endDate"), (4, 2, "ask", "leaveType,startDate,endDate")]
    assert go(6, (1, 2, "answer", say(startDate="mon", endDate="")), (4, 2, "answer", '"free text"'), (4, 1, "run", None)) == sorted(want, key=repr)
    want += [(1, 3, "done", say(endDate="tue", leaveType="sick", startDate="mon")), (1, 4, "ignored", None), (4, 3, "ask", "startDate,endDate")]
    assert go(9, (1, 3, "answer", say(endDate="tue")), (1, 4, "answer", say(endDate="wed")), (4, 3, "run", say(leaveType="x"))) == sorted(want, key=repr)


def test_a_question_is_forgotten_after_its_time(spark, tmp_path):
    schema, path = "conv_id long, seq long, kind string, given string", str(tmp_path / "in")
    make = lambda rows: K.interrupted(rows, ("a",), ttl_s=1)
    put(spark, path, schema, [(1, 1, "run", None)])
    assert upto(spark, make, path, schema, tmp_path, "old", 1) == [(1, 1, "ask", "a")]
    time.sleep(1.5)
    put(spark, path, schema, [(1, 2, "answer", '{"a": 1}')])
    assert upto(spark, make, path, schema, tmp_path, "old", 2) == [(1, 1, "ask", "a"), (1, 2, "ignored", None)]


def test_of_writers_with_one_base_one_wins(spark, tmp_path):
    schema, path, out = "key string, writer string, base long", str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, path, schema, [("doc", f"w{k}", 0) for k in range(40)] + [("other", "x", None), ("stale", "y", 3)])
    put(spark, path, schema, [("doc", f"v{k}", 0) for k in range(5)] + [("doc", "next", 1), ("doc", "next too", 1), ("other", "x", 1)])
    for _ in range(2):  # the second run finds nothing new
        q = K.split_writes(K.guarded_writes(source(spark, path, schema)), out, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    took = spark.read.parquet(f"{out}/accepted").collect()
    assert Counter((r["key"], r["revision"]) for r in took) == {("doc", 1): 1, ("doc", 2): 1, ("other", 1): 1, ("other", 2): 1}
    refused = spark.read.parquet(f"{out}/rejected").collect()
    assert len(refused) == 39 + 5 + 1 + 1 and {r["code"] for r in refused} == {"REVISION_CONFLICT"}
    assert {r["revision"] for r in refused if r["writer"].startswith("v")} <= {1, 2} and {r["revision"] for r in refused if r["key"] == "stale"} == {0}
