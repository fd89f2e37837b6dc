"""Rules that take the rows of a key one after the other, as steps that batch and stream share.

In batch, rows are dealt and sorted by key and order, and stream through the step in Arrow batches: a key of any size holds one
state and no rows. In a stream the state lies in the state store (streaming.stateful)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

# Failures in a row that open the breaker, its cooldown, life of a cache entry.
THRESHOLD, COOLDOWN_MS, TTL_MS = 3, 120_000, 300_000

ARROW = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}

#: A step takes the state of the key (None at first) and a row's values; it returns the new state and the rows that come out.
Step = Callable[[Any, tuple], tuple[Any, list[tuple]]]


def replayed(df: DataFrame, keys: list[str], order: list[str], values: list[str], step: Step, schema: str, last: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """The rows that `step` makes of the rows of each key in order: the keys, then the columns of `schema` (of types in ARROW).

    last: rows that a key's state leaves behind when its rows are over. Null keys are one key; ties of the order are the
    caller's to break."""
    kept = df.select(*keys, *[c for c in dict.fromkeys([*order, *values]) if c not in keys])
    kinds = dict(kept.dtypes)
    fields = [(k, kinds[k]) for k in keys] + [tuple(c.split()) for c in schema.split(", ")]

    def table(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], ARROW[t]) for k, (_, t) in enumerate(fields)], names=[f[0] for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, started = None, None, False
        for batch in batches:
            made: list[tuple] = []
            columns = {c: batch.column(c).to_pylist() for c in {*keys, *values}}
            for n in range(batch.num_rows):
                own = tuple(columns[k][n] for k in keys)
                if not started or own != key:
                    if started and last:
                        made += [(*key, *r) for r in last(state)]
                    key, state, started = own, None, True
                state, rows = step(state, tuple(columns[v][n] for v in values))
                made += [(*own, *r) for r in rows]
            yield table(made)
        if started and last:
            yield table([(*key, *r) for r in last(state)])

    return kept.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ", ".join(" ".join(f) for f in fields))


def breaker_step(state: tuple[int, int] | None, row: tuple) -> tuple[tuple[int, int], list[tuple]]:
    """row: (id, ok, at_ms) of a call that wants to go out; comes back as (id, state before it).

    Three failures in a row open the breaker. While it is open calls are not made, so they count for nothing. The first call
    more than the cooldown after it opened finds it half open: it goes out, and the count begins again."""
    failures, opened = state or (0, 0)
    number, ok, at = row
    found = "closed"
    if failures >= THRESHOLD:
        if at - opened <= COOLDOWN_MS:
            return (failures, opened), [(number, "open")]
        failures, found = 0, "half_open"
    failures = 0 if ok else failures + 1
    return (failures, at if failures >= THRESHOLD else opened), [(number, found)]


def ttl_step(written: int | None, row: tuple) -> tuple[int, list[tuple]]:
    """row: (id, at_ms) of a lookup; comes back as (id, hit). An entry lives from when it was written; a miss writes it."""
    number, at = row
    hit = written is not None and at - written < TTL_MS
    return written if hit else at, [(number, hit)]


def frame_step(held: list[str] | None, row: tuple) -> tuple[list[str], list[tuple]]:
    """row: (text,) of a chunk; comes back as the frames that it completes. A frame ends at a blank line; the rest waits.

    What waits is put together only when its end has come, so a frame in many chunks costs its length once."""
    held, text = held or [], row[0] or ""
    before = next((h for h in reversed(held) if h), "")
    if "\n\n" not in before[-1:] + text:
        held.append(text)
        return held, []
    *frames, tail = ("".join(held) + text).split("\n\n")
    return [tail], [(f, True) for f in frames if f.strip()]


def unfinished(held: list[str] | None) -> list[tuple]:
    """What is left of a stream that ended within a frame."""
    tail = "".join(held or [])
    return [(tail, False)] if tail.strip() else []
