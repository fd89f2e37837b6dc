"""Streams that act on silence, wait for answers and refuse stale writes: keyed state with timers and a time to live.

These need a state store with column families: set `spark.sql.streaming.stateStore.providerClass` to STORE before the query starts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Seconds without an event until a keepalive, seconds between heartbeats, their text, the end of a stream.
QUIET_S, BEAT_S, KEEPALIVE, PING, END = 30, 15, ": keepalive\n\n", ": ping\n\n", "end"

FRAMES = "stream string, at_ms long, kind string, frame string"
ASKED = "conv_id long, seq long, kind string, told string"
WRITES = "key string, writer string, ok boolean, revision long, code string"


class _Alive(StatefulProcessor):
    def __init__(self, quiet_ms: int, beat_ms: int):
        self.quiet_ms, self.beat_ms = quiet_ms, beat_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "quiet long, beat long")

    def _set(self, quiet: int, beat: int) -> None:
        """One timer, at whichever is due first."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.due.update((quiet, beat))
        self.handle.registerTimer(min(quiet, beat))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, ended = timerValues.getCurrentProcessingTimeInMs(), False
        for part in rows:
            ended = ended or bool((part["kind"] == END).any())
            yield pd.DataFrame({"stream": key[0], "at_ms": now, "kind": part["kind"], "frame": part["frame"]})
        beat = self.due.get()[1] if self.due.exists() else now + self.beat_ms
        if ended:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.due.clear()
        else:
            self._set(now + self.quiet_ms, beat)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.due.exists():
            return
        quiet, beat = self.due.get()
        out = []
        if quiet <= now:
            out.append((key[0], now, "keepalive", KEEPALIVE))
            quiet = now + self.quiet_ms
        if beat <= now:
            out.append((key[0], now, "ping", PING))
            beat = now + self.beat_ms
        self._set(quiet, beat)
        yield pd.DataFrame(out, columns=["stream", "at_ms", "kind", "frame"])

    def close(self) -> None:
        pass


def kept_alive(frames: DataFrame, quiet_s: float = QUIET_S, beat_s: float = BEAT_S) -> DataFrame:
    """K-03, K-04: frames (stream, kind, frame) as they come, a keepalive wherever a stream was silent for `quiet_s`, a heartbeat
    every `beat_s` from its first frame, both until a frame of kind `end`.

    The timers are those of processing time: they fire although nothing arrives. A late trigger gives one comment, not all that
    were missed. A stream holds two numbers in state and no rows; after its end it holds nothing."""
    return frames.select("stream", "kind", "frame").groupBy("stream").transformWithStateInPandas(_Alive(int(quiet_s * 1000), int(beat_s * 1000)), FRAMES, "Append", "ProcessingTime")


class _Asking(StatefulProcessor):
    def __init__(self, required: tuple[str, ...], ttl_ms: int):
        self.required, self.ttl_ms = required, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "name string", "value string", self.ttl_ms)
        self.asked = handle.getValueState("asked", "seq long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The rows that a conversation gets in one micro-batch: what people typed meanwhile.
        each = sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: r.seq)
        out = []
        for r in each:
            given = json.loads(r.given) if r.given else {}
            if r.kind == "run":
                self.known.clear()
                self.asked.clear()
            elif not self.asked.exists():
                out.append((key[0], r.seq, "ignored", None))  # nothing was asked, or too long ago
                continue
            for name, value in (given if isinstance(given, dict) else {"text": given}).items():
                if value not in (None, ""):
                    self.known.updateValue((name,), (str(value),))
            self.asked.clear()
            missing = [n for n in self.required if not self.known.containsKey((n,))]
            if missing:
                self.asked.update((r.seq,))
                out.append((key[0], r.seq, "ask", ",".join(missing)))
            else:
                found = {k[0]: v[0] for k, v in self.known.iterator()}
                self.known.clear()
                out.append((key[0], r.seq, "done", json.dumps(found, ensure_ascii=False, sort_keys=True)))
        yield pd.DataFrame(out, columns=["conv_id", "seq", "kind", "told"])

    def close(self) -> None:
        pass


def interrupted(rows: DataFrame, required: tuple[str, ...], ttl_s: float = 86_400) -> DataFrame:
    """K-09: runs that stop for a question and go on with the answer. rows: conv_id, seq, kind (run or answer), given (JSON: an object
    of names and values, or a text, which is known as `text`).

    A run that lacks a required name asks for all that it lacks and is suspended; an answer adds to what is known, takes the
    question back and runs again, which may ask once more. A new run forgets the suspended one. What waits longer than `ttl_s`
    for an answer is forgotten by the store itself; an answer to nothing is told as ignored. Suspended runs lie in the
    checkpoint, so they outlive restarts."""
    return rows.select("conv_id", "seq", "kind", "given").groupBy("conv_id").transformWithStateInPandas(_Asking(tuple(required), int(ttl_s * 1000)), ASKED, "Append", "ProcessingTime")


class _Guarded(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "revision long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.current.get()[0] if self.current.exists() else 0
        for part in rows:
            out = []
            for writer, base in zip(part["writer"], part["base"]):
                if pd.isna(base) or int(base) == now:
                    now += 1
                    out.append((key[0], writer, True, now, None))
                else:
                    out.append((key[0], writer, False, now, "REVISION_CONFLICT"))
            yield pd.DataFrame(out, columns=["key", "writer", "ok", "revision", "code"])
        self.current.update((now,))

    def close(self) -> None:
        pass


def guarded_writes(writes: DataFrame) -> DataFrame:
    """K-17: compare and set. writes: key, writer, base (the revision that the writer saw; none: whatever it is).

    A write whose base is the key's revision takes effect and makes the next one; any other is refused with the revision that is
    there. Of writers with one base exactly one wins, whichever comes first, in one micro-batch or in several. A key holds one
    number; rows pass one by one."""
    return writes.select("key", "writer", "base").groupBy("key").transformWithStateInPandas(_Guarded(), WRITES, "Append", "None")


def split_writes(results: DataFrame, path: str, checkpoint: str):
    """The writer of a stream of guarded_writes: what took effect under `path`/accepted, what was refused under `path`/rejected.

    A micro-batch that runs again replaces its own folders and nothing else."""

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, kept in (("accepted", F.col("ok")), ("rejected", ~F.col("ok"))):
            batch.where(kept).drop("ok").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return results.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
