from pyspark.sql import functions as F

from threadloom.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.estimate_tokens, "中" * 100) == 150
    assert one(spark, T.estimate_tokens, "a" * 400) == 100
    assert one(spark, T.estimate_tokens, None) == 0
    assert T.compress_trigger(200_000) == 125_999  # 180 000 * 0.70 is a little below 126 000 in double precision, and truncated
    assert T.compress_trigger(10_000) == -7_000


def test_redact_is_ordered_and_idempotent(spark):
    assert one(spark, T.redact, "key=sk-abc123456789012345") == "key=sk-***REDACTED***"
    once = one(spark, T.redact, "Authorization: Bearer abc.def x-token=1 cookie: a=b")
    assert "abc.def" not in once and one(spark, T.redact, once) == once


def test_sanitize(spark):
    assert one(spark, T.sanitize, "﻿ＡＢＣ​x") == "ABCx"
    assert one(spark, T.sanitize, None) is None


def test_json_from_text(spark):
    for reply in ('{"k":1}', 'a\n```json\n{"k":1}\n```', 'so {"k":1} it is'):
        assert one(spark, T.json_from_text, reply) == '{"k":1}'
    assert one(spark, T.json_from_text, "none") is None
    assert one(spark, T.json_from_text, None) is None


def test_event_and_data_of_a_frame(spark):
    frames = {"event: a\ndata: {\"x\":\ndata: 1}": ("a", '{"x":1}'), "event: a\nevent:\t b \ndata:x \ndata:\tx": ("b", "xx"), "data: 1": (None, "1"), ": ping": (None, ""), "event:\ndata: 2": (None, "2"), "event: a\r\ndata: z\r": ("a", "z"), " event: no\nevents: no\ndatax: 1\nevent: yes": ("yes", "")}
    rows = spark.createDataFrame([(f,) for f in frames], "f string")
    got = {r[0]: (r[1], r[2]) for r in rows.select("f", T.sse_event(F.col("f")), T.sse_data(F.col("f"))).collect()}
    assert got == frames
