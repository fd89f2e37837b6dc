import datetime

import pytest

from threadloom.operators import replays
from threadloom.streaming import stateful as S


def run(spark, frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def streamed(spark, tmp_path, name, schema, *parts):
    """A stream that brings the parts one micro-batch after the other."""
    src = str(tmp_path / name)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


CALLS = [(1, 1, False, 0), (1, 2, False, 1), (1, 3, False, 2), (1, 4, True, 3), (1, 5, False, 120_002), (1, 6, False, 120_003), (1, 7, False, 120_004), (1, 8, False, 120_005), (1, 9, True, 120_006), (1, 10, False, 240_010)]
STATES = {1: "closed", 2: "closed", 3: "closed", 4: "open", 5: "open", 6: "half_open", 7: "closed", 8: "closed", 9: "open", 10: "half_open"}


@pytest.mark.parametrize("cut", [3, 6])
def test_breaker_over_two_batches(spark, tmp_path, cut):
    """Half open after more than the cooldown; then three more failures, not one, open it again. An open breaker counts nothing."""
    schema = "conv_id long, seq long, ok boolean, ts_ms long"
    stream = streamed(spark, tmp_path, "src", schema, CALLS[:cut], CALLS[cut:])
    assert {r.seq: r.state for r in run(spark, S.breaker(stream), f"breaker{cut}")} == STATES
    batch = spark.createDataFrame(CALLS, schema)
    got = replays.replayed(batch, ["conv_id"], ["seq"], ["seq", "ok", "ts_ms"], replays.breaker_step, "id long, state string")
    assert {r.id: r.state for r in got.collect()} == STATES


def test_success_resets_the_breaker():
    state = None
    for n, ok in enumerate([False, False, True, False, False]):
        state, rows = replays.breaker_step(state, (n, ok, n))
        assert rows == [(n, "closed")]


def test_cache_lives_from_the_write(spark, tmp_path):
    rows = [("a", n, 100_000 * n) for n in range(8)] + [("b", 0, 0)]
    want = {("a", 0): False, ("a", 1): True, ("a", 2): True, ("a", 3): False, ("a", 4): True, ("a", 5): True, ("a", 6): False, ("a", 7): True, ("b", 0): False}
    stream = streamed(spark, tmp_path, "src", "key string, seq long, ts_ms long", rows[:4], rows[4:])
    assert {(r.key, r.seq): r.hit for r in run(spark, S.cache_hits(stream), "cache")} == want


def test_frames_over_chunks(spark):
    text = "event: a\ndata: {\"k\": 1}\n\nevent: b\ndata: x\n\n\n\nevent: c\nda"
    for size in (1, 2, 5, 1000):
        chunks = [(7, n, text[i : i + size]) for n, i in enumerate(range(0, len(text), size))] + [(8, 0, None), (None, 0, "data: 1\n\n")]
        df = spark.createDataFrame(chunks, "conv_id long, n long, text string")
        got = replays.replayed(df, ["conv_id"], ["n"], ["text"], replays.frame_step, "frame string, whole boolean", replays.unfinished).collect()
        assert sorted((r.conv_id, r.frame, r.whole) for r in got if r.conv_id) == [(7, "event: a\ndata: {\"k\": 1}", True), (7, "event: b\ndata: x", True), (7, "event: c\nda", False)]
        assert [r.frame for r in got if r.conv_id is None] == ["data: 1"]


def test_idle_sessions(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    stream = streamed(spark, tmp_path, "src", "conv_id long, ts timestamp", [(1, at(0)), (1, at(59)), (1, at(130)), (2, at(5))], [(1, at(7200))], [(3, at(9000))])
    got = {(r.conv_id, r.n) for r in run(spark, S.idle_sessions(stream), "idle")}
    assert {(1, 2), (1, 1), (2, 1)} <= got and sum(n for c, n in got if c == 1) >= 3


def test_matched_replies(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    asked = streamed(spark, tmp_path, "asked", "id string, ts timestamp", [("a", at(0)), ("b", at(1)), ("c", at(2))], [("z", at(3600))], [("y", at(7200))])
    answered = streamed(spark, tmp_path, "answered", "id string, ts timestamp, payload string", [("a", at(4), "in time"), ("b", at(60), "too late")], [("z", at(3605), "in time")], [("q", at(7200), "nobody asked")])
    got = {(r.id, r.payload) for r in run(spark, S.matched_replies(asked, answered), "replies")}
    assert {("a", "in time"), ("b", None), ("c", None), ("z", "in time")} == got - {("y", None)}


def test_read_model_upsert(spark, tmp_path):
    schema, model = "conv_id long, seq long, config string", str(tmp_path / "model")
    stream = streamed(spark, tmp_path, "src", schema, [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], [(2, 5, "d"), (3, 1, "e"), (1, 1, "late")])
    S.upsert_read_model(stream, model, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    at = lambda *upto: {r.conv_id: r.config for r in S.read_model(spark, model, *upto).collect()}
    assert at(0) == {1: "b", 2: "c"} and at() == {1: "b", 2: "d", 3: "e"}
    assert S.compact(spark, model, str(tmp_path / "compact")) == 1
    assert {r.conv_id: r.config for r in S.read_model(spark, str(tmp_path / "compact")).collect()} == at()
