"""Line diff by longest common subsequence, deletions before additions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

from pyspark.sql import Column, SparkSession, functions as F

#: The guard of the reference: in tables of more cells all old lines go and all new lines come. It is a rule only for callers that ask for it;
#: no query does.
MOST_CELLS = 4_000_000
#: Bits of the table that are held at a time, unless its shorter form by square roots needs more.
HELD_BITS = 1 << 26
COUNT_TYPE = "struct<added:int,removed:int>"
DIFF_TYPE = "array<struct<type:string,old_no:int,new_no:int,text:string>>"


def _places(y: list) -> tuple[dict, int]:
    """Of each line of y the bits of its places, counted from the end, and a bit for every place."""
    at: dict = {}
    for j, s in enumerate(reversed(y)):
        at[s] = at.get(s, 0) | 1 << j
    return at, (1 << len(y)) - 1


def _common(x: Iterable, at: dict, every: int, row: int) -> Iterator[int]:
    """The rows of the table of common lengths that lines x, from the end, add to a row: numbers whose bits are 0 where one more line is
    in common (Hyyrö's bit-parallel form). The lowest bits stand for the end of y; `every` is the row of no lines."""
    for s in x:
        hit = row & at.get(s, 0)
        row = ((row + hit) | (row - hit)) & every
        yield row


def diff_lines(old: str, new: str, most_cells: int | None = MOST_CELLS) -> list[tuple]:
    """(type, old_no, new_no, text) with type ctx, del or add; numbers count from 1 and are null on the other side.

    most_cells: None for texts of any size by one rule. Of a large table only some rows are kept, and those between are made
    again as the walk comes to them: memory grows with the lines of one text times the square root of the other's."""
    a, b = old.split("\n"), new.split("\n")
    n, m = len(a), len(b)
    if most_cells is not None and n * m > most_cells:
        return [("del", i + 1, None, s) for i, s in enumerate(a)] + [("add", None, j + 1, s) for j, s in enumerate(b)]
    out, i, j = [], 0, 0
    while i < n and i < m and a[i] == b[i]:
        out.append(("ctx", i + 1, i + 1, a[i]))
        i += 1
    j = start = i
    at, every = _places(b[start:])
    back = a[: start - 1 if start else None : -1] if j < m else []  # the lines of a that are left, from the end
    step = max(isqrt(len(back)) + 1, HELD_BITS // max(1, m - start))
    marks, first = [every], (len(back) - 1) // step * step
    for k, row in enumerate(_common(back[: max(0, first)], at, every, every), 1):
        if k % step == 0:
            marks.append(row)
    base, rows = len(back) + 1, []
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(("ctx", i + 1, j + 1, a[i]))
            i, j = i + 1, j + 1
            continue
        gone = i < n and j == m
        if i < n and j < m:
            k = n - i  # rows[k - base] is the row of a[i:]
            if k - 1 < base:
                q = (k - 1) // step
                base, rows = q * step, [marks[q], *_common(back[q * step : (q + 1) * step], at, every, marks[q])]
            # The lowest m - j bits of a row count for b[j:].
            common = lambda row, j: ((row ^ every) & ((1 << m - j) - 1)).bit_count()
            gone = common(rows[k - 1 - base], j) >= common(rows[k - base], j + 1)
        if gone:
            out.append(("del", i + 1, None, a[i]))
            i += 1
        else:
            out.append(("add", None, j + 1, b[j]))
            j += 1
    return out


def changed_lines(old: str, new: str, most_cells: int | None = MOST_CELLS) -> tuple[int, int]:
    """How many rows of `diff_lines` are add and how many are del. One row of the table is held."""
    a, b = old.split("\n"), new.split("\n")
    n, m = len(a), len(b)
    if most_cells is not None and n * m > most_cells:
        return m, n
    # What both begin and end with is in common whatever lies between.
    start = 0
    while start < n and start < m and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    row, (at, every) = None, _places(b[start:m])
    for row in _common(reversed(a[start:n]), at, every, every):
        pass
    same = 0 if row is None else (row ^ every).bit_count()
    return m - start - same, n - start - same


def line_diff(old: Column, new: Column) -> Column:
    """Diff rows of two texts of any size as an array; null texts count as empty."""

    @F.udf(DIFF_TYPE, useArrow=True)
    def run(a: str | None, b: str | None) -> list:
        return [dict(zip(("type", "old_no", "new_no", "text"), r)) for r in diff_lines(a or "", b or "", None)]

    return run(old, new)


def line_counts(old: Column, new: Column) -> Column:
    """(added, removed): the numbers of rows that the diff of two texts has of these kinds; null texts count as empty.

    Text and diff stay in Python one row at a time; what comes back is two numbers."""

    @F.udf(COUNT_TYPE, useArrow=True)
    def run(a: str | None, b: str | None) -> dict:
        return dict(zip(("added", "removed"), changed_lines(a or "", b or "", None)))

    return run(old, new)


def bound_batches(spark: SparkSession) -> None:
    """Hold the Arrow batches in which whole texts go to Python and their diffs come back to a size that does not grow with the table.

    These are settings of the session, and they stay: a frame is only planned when its reader asks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
