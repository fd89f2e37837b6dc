"""Frames of growing files once each over restarts; assets by pushed filters, staged writes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from threadloom.sources import assets as A, event_source as S


def told(rows):
    return sorted((r["stream"], r["seq"], r["event"], r["data"], r["frames"]) for r in rows)


@pytest.mark.parametrize("look", [1, 3, 1 << 16])
def test_slices_at_any_byte_give_each_frame_once(tmp_path, monkeypatch, look):
    monkeypatch.setattr(S, "LOOK_BYTES", look)
    text = "event: a\ndata: {\"é\":\ndata: 1}\n\n\n\n: ping\n\ndata: x\n\nevent: b\nevent: c\n\nevent: end\n\nevent: late\n\nevent: torn".encode()
    path = tmp_path / "s"
    path.write_bytes(text)
    whole = list(S.rows(S.Slice(str(path), "s", 0, len(text))))
    assert [r[2:] for r in whole] == [("a", '{"é":1}', None), ("c", "", None), ("end", "", 3)]
    end = whole[-1][1]
    for k in range(1, len(text)):
        cut = list(S.rows(S.Slice(str(path), "s", 0, k))) + [r for r in S.rows(S.Slice(str(path), "s", k, len(text))) if r[1] <= end]
        assert cut == whole, k
    ones = [r for k in range(end) for r in S.rows(S.Slice(str(path), "s", k, k + 1))]
    assert ones == whole


def test_a_stream_over_restarts(spark, tmp_path):
    S.register(spark)
    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    rng, texts = random.Random(41), {}
    for name in ("s1", "s2"):
        frames = [f"event: t{k % 3}\ndata: {json.dumps({'k': k, 'x': 'é' * rng.randrange(9)})}\n\n" for k in range(40)]
        texts[name] = ("".join(frames) + "event: end\ndata: {}\n\n").encode()
    done = dict.fromkeys(texts, 0)
    for _ in range(4):  # the files grow by any bytes, then the query runs from its checkpoint
        for name, text in texts.items():
            to = len(text) if _ == 3 else min(len(text), done[name] + rng.randrange(1, 700))
            with (folder / name).open("ab") as f:
                f.write(text[done[name] : to])
            done[name] = to
        stream = spark.readStream.format("event_frames").option("most_bytes", "500").load(str(folder)) if _ % 2 else spark.readStream.format("event_frames").load(str(folder))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(processingTime="100 milliseconds").start()
        q.processAllAvailable()
        q.stop()
    batch = spark.read.format("event_frames").load(str(folder))
    got = told(spark.read.parquet(out).collect())
    assert got == told(batch.collect()) and len(got) == 82
    ends = {r[0]: r[4] for r in got if r[2] == "end"}
    assert ends == {"s1": 41, "s2": 41}  # as many as there are: nothing is missing


def put(spark, rows, folder, mode="append"):
    spark.createDataFrame(rows, "kind string, name string, body string").repartition(3).write.format("assets").mode(mode).save(folder)


def test_assets_by_kind_and_name(spark, tmp_path):
    A.register(spark)
    folder = str(tmp_path / "assets")
    put(spark, [("templates", f"t{k}", json.dumps({"k": k})) for k in range(20)] + [("schemas", "form", "{}"), ("guides", "intro.md", "# é"), ("other", "x", None)], folder)
    every = spark.read.format("assets").load(folder)
    assert every.count() == 23 and {r["name"] for r in every.where("kind <> 'templates'").collect()} == {"form.schema.json", "intro.md", "x"}
    assert [(r["body"], r["bytes"]) for r in every.where("kind = 'guides'").collect()] == [("# é", 4)]
    one = every.where((F.col("kind") == "templates") & F.col("name").isin("t3.json", "t4.json", "none.json"))
    assert sorted(r["name"] for r in one.collect()) == ["t3.json", "t4.json"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and " Filter " not in plan  # the source has taken all of it over
    assert [r["name"] for r in every.where("name like 't1%' and body like '%19%'").collect()] == ["t19.json"]
    reader = A._Reader(folder)
    assert list(reader.pushFilters([A.EqualTo(("kind",), "templates"), A.In(("name",), ("t1.json", "t2.json")), A.EqualTo(("body",), "x")])) == [A.EqualTo(("body",), "x")]
    assert [p.files for p in reader.partitions()] == [[("templates", "t1.json"), ("templates", "t2.json")]]


def test_a_failed_write_changes_no_asset(spark, tmp_path):
    A.register(spark)
    folder = str(tmp_path / "assets")
    put(spark, [("forms", "a", "old"), ("forms", "b", "old")], folder)
    with pytest.raises(Exception, match="no asset can be called"):
        put(spark, [("forms", "a", "new"), ("forms", "../b", "x")] + [("forms", f"n{k}", "x") for k in range(20)], folder)
    read = lambda: {r["name"]: r["body"] for r in spark.read.format("assets").load(folder).collect()}
    assert read() == {"a.json": "old", "b.json": "old"} and not [x for x in os.listdir(folder) if x.startswith("_")]
    put(spark, [("forms", "a", "new"), ("forms", "a", "newer"), ("forms", "a.json", "n")], folder)
    assert read() == {"a.json": "newer", "b.json": "old"}
    put(spark, [("forms", "c", "x")], folder, "overwrite")
    assert read() == {"c.json": "x"}
