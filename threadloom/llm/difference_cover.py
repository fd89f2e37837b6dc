"""Exact dedup of repeated word sequences by difference-cover anchors.

A word goes if a WINDOW-word sequence that covers it also starts in a document with a smaller id.

1. Shorter runs of words are hashed only where their place modulo PERIOD is in a difference cover: for any two places some shift
   below PERIOD puts both into the cover. So two equal windows, wherever they stand, share an anchor at the same shift. An anchor
   serves the windows that can have it at such a shift; the words of all of them are its stretch.
2. Anchors meet by their hash. Of those whose whole stretch is the same, all but the ones of the smallest document are repeats.
   Where an anchor stands in different stretches of different documents, the windows of each are asked for: they are hashed from
   the text, meet by that hash, and all but those of the smallest document are repeats.
3. Repeats are gathered per document, and the words that they cover are cut out.

Before anything is dealt, equal stretches (and windows) of a part of the input are decided among themselves, so a hot one travels
once a part. A bucket that has too many anchors for its task asks for all of their windows instead of holding them. Equality is
that of 64 bits of the anchor and 64 other bits of the stretch, and of 128 bits of a window."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bound_batches, give_back, materialize, spans_at_space

WINDOW, PERIOD = 50, 31
#: Perfect difference covers by period. Other periods get one of about twice the square root of the period.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
#: Text bytes whose anchors share a bucket on average, text bytes hashed at a time, text bytes dealt at a time, anchors held by a task.
BUCKET_BYTES, GROUP_BYTES, PART_BYTES, MOST_HELD = 16 << 20, 1 << 20, 1 << 23, 1 << 23
#: Words of more bytes are hashed one by one.
LONG_WORD = 1 << 12
#: The place in the order of documents without an id.
NO_ID = 2**63 - 1

DEALT = "bucket int, doc array<long>, row array<long>, n_each array<int>, key array<long>, check array<long>, start array<int>, n array<int>, decided boolean"
RANGES = "doc long, row long, start int, n int, asked boolean"


def cover(period: int) -> tuple[int, ...]:
    """Places modulo `period` such that any two numbers are both in it after some common shift."""
    if period in COVERS:
        return COVERS[period]
    step = math.isqrt(max(0, period - 1)) + 1
    return tuple(sorted({*range(min(step, period)), *range(0, period, step)}))


def mixed(h: np.ndarray, odd: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    """Scrambled 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(odd)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Sums:
    """Hashes of any stretches of a sequence of 64-bit numbers, from running sums weighted by powers of an odd base."""

    def __init__(self, numbers: np.ndarray, base: int):
        size = len(numbers) + 1
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        self.back = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.back, out=self.back)
        self.upto = np.zeros(size, np.uint64)
        np.cumsum(numbers * powers[:-1], out=self.upto[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.upto[end] - self.upto[start]) * self.back[start])


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _words(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = (x != 32) & ((x < 9) | (x > 13))
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out = Sums(_BYTES[x], 0xD6E8FEB86659FD93).of(start, end) ^ mixed((end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG_WORD):
        out[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]])
    return out


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, in order, in memory that a long text does not raise by more than its words."""
    out = []
    for part in spans_at_space(data, GROUP_BYTES):
        if len(part) <= 2 * GROUP_BYTES:
            out.append(_words(part))
            continue
        own = part.split()  # a word of a million bytes
        long = np.array([len(w) > LONG_WORD for w in own], bool)
        hashes = np.zeros(len(own), np.uint64)
        hashes[~long] = word_hashes(b" ".join(compress(own, ~long))) if not long.all() else 0
        hashes[long] = [xxhash.xxh64_intdigest(w) for w in compress(own, long)]
        out.append(hashes)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words of each text)."""
    each = [word_hashes(t) for t in texts]
    return (np.concatenate(each) if each else np.zeros(0, np.uint64)), np.array([len(e) for e in each], np.int64)


def anchors(h: np.ndarray, sizes: np.ndarray, window: int, period: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, stretch hash, first window start, windows) of every anchor that serves a window, in order of texts."""
    marks = np.zeros(period, bool)
    marks[list(cover(period))] = True
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(h)) - first[owner]
    low = np.maximum(place - (period - 1), 0)
    high = np.minimum(place, sizes[owner] - window)
    at = np.flatnonzero(marks[place % period] & (high >= low) & (place + (window - period + 1) <= sizes[owner]))
    owner, place, low, high = owner[at], place[at], low[at], high[at]
    begins = first[owner]
    key = Sums(h, 0x9E3779B97F4A7C15).of(at, at + (window - period + 1))
    check = Sums(mixed(h, 0x2545F4914F6CDD1D), 0xBF58476D1CE4E5B9).of(begins + low, begins + high + window)
    shape = (place - low) * period + (high - low)
    return owner, key, mixed(check ^ mixed(shape.astype(np.uint64))), low, high - low + 1


def windows(h: np.ndarray, sizes: np.ndarray, asked: list[np.ndarray], window: int) -> tuple[np.ndarray, ...]:
    """(text number, two hashes, start, 1) of the asked window starts of each text."""
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), [len(a) for a in asked])
    start = np.concatenate([*asked, np.zeros(0, np.int64)]).astype(np.int64)
    at = first[owner] + start
    return owner, Sums(h, 0xA0761D6478BD642F).of(at, at + window), Sums(mixed(h, 0x2545F4914F6CDD1D), 0xE7037ED1A0B428DB).of(at, at + window), start, np.ones(len(at), np.int64)


def joined(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same window starts in the fewest ranges, in order."""
    turn = np.argsort(start, kind="stable")
    start, end = start[turn].astype(np.int64), np.maximum.accumulate((start + n)[turn].astype(np.int64))
    opens = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else np.zeros(0, int)
    return start[opens], end[np.concatenate([opens[1:] - 1, [len(end) - 1]])] - start[opens] if len(start) else start


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    wide = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(wide.astype(kind.to_pandas_dtype()), kind))


def _deal(found: tuple[np.ndarray, ...], doc: np.ndarray, row: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Records (text number, key, check, start, n) of a part, by bucket of their key. Equal ones of a larger document are decided.

    doc, row: of each text, in order of doc."""
    own, key, check, start, n = found
    turn = np.lexsort((own, check, key))  # texts are in order of doc: the first of equal records is of the smallest
    head = np.concatenate([[True], (np.diff(key[turn]) != 0) | (np.diff(check[turn]) != 0)]) if len(turn) else np.zeros(0, bool)
    least = doc[own[turn[np.flatnonzero(head)[np.cumsum(head) - 1]]]] if len(turn) else np.zeros(0, np.int64)
    gone = np.zeros(len(own), bool)
    gone[turn] = doc[own[turn]] > least
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = ["bucket", "doc", "row", "n_each", "key", "check", "start", "n", "decided"]
    # Decided ones go by their document, not to the bucket of a key that may be hot; each document's in as few ranges as they are.
    texts, begins = np.unique(own[gone], return_index=True)
    runs = [joined(s, k) for s, k in zip(np.split(start[gone], begins[1:]), np.split(n[gone], begins[1:]))] if len(texts) else []
    if runs:
        lone = np.arange(len(texts) + 1)
        counts = np.array([len(r[0]) for r in runs])
        cuts, none = np.concatenate([[0], np.cumsum(counts)]), np.zeros(len(texts) + 1, int)
        values = (doc[texts], row[texts], counts, key[:0], check[:0], *(np.concatenate([r[k] for r in runs]) for k in (0, 1)))
        where = (lone, lone, lone, none, none, cuts, cuts)
        where_to = (row[texts] ^ doc[texts]) % buckets
        yield pa.RecordBatch.from_arrays([pa.array(where_to, pa.int32()), *(_lists(v, c, t) for v, c, t in zip(values, where, kinds)), pa.array([True] * len(texts))], names=names)
    own, key, check, start, n = (v[~gone] for v in (own, key, check, start, n))
    bucket = (key >> np.uint64(32)).astype(np.int64) % buckets
    turn = np.argsort(bucket, kind="stable")  # texts stay in order inside a bucket
    own, key, check, start, n, bucket = (v[turn] for v in (own, key, check, start, n, bucket))
    if len(own):
        opens = np.flatnonzero(np.concatenate([[True], (np.diff(bucket) != 0) | (np.diff(own) != 0)]))  # a text in a bucket
        there, firsts = np.unique(bucket[opens], return_index=True)
        by_text = np.concatenate([firsts, [len(opens)]])
        by_record = np.concatenate([opens[firsts], [len(own)]])
        values = (doc[own[opens]], row[own[opens]], np.diff(np.concatenate([opens, [len(own)]])), key, check, start, n)
        where = (by_text,) * 3 + (by_record,) * 4
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *(_lists(v, c, t) for v, c, t in zip(values, where, kinds)), pa.array([False] * len(there))], names=names)


def dealt(buckets: int, window: int, period: int | None):
    """Rows (doc, row, data[, start, n]) to records by bucket: anchors of all their windows, or (period None) the asked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((row, doc))
            # A row that repeats id and text is the same document.
            order = order[np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(row[order]) != 0)])] if len(order) else order
            doc, row, data = doc[order], row[order], batch.column(2)
            found, texts, asked, number, held, since = [], [], [], 0, 0, 0
            for k, i in enumerate(order.tolist()):
                texts.append(data[i].as_buffer().to_pybytes())
                held += len(texts[-1])
                if period is None:
                    low, n = joined(*(np.asarray(batch.column(c)[i].values, np.int64) for c in (3, 4)))
                    asked.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n))
                last = k == len(order) - 1
                if held >= GROUP_BYTES or last:
                    h, sizes = hashed(texts)
                    own, *rest = anchors(h, sizes, window, period) if period else windows(h, sizes, asked, window)
                    found.append((own + number, *rest))
                    number += len(texts)
                    since += held
                    texts, asked, held = [], [], 0
                if found and (since >= PART_BYTES or last):
                    yield from _deal(tuple(np.concatenate(c) for c in zip(*found)), doc, row, buckets)
                    found, since = [], 0
            del data, batch
            give_back()

    return run


def _told(doc: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, asked: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    columns = [pa.array(v.astype(t.to_pandas_dtype()), t) for v, t in zip((doc, row, start, n), kinds)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(doc), asked))], names=["doc", "row", "start", "n", "asked"])


def repeats(doc, row, key, check, start, n, ask: bool) -> Iterator[pa.RecordBatch]:
    """Of records that met: those with an equal one in a smaller document; with `ask`, those of a key in different stretches of
    different documents whose windows must be compared one by one."""
    turn = np.lexsort((doc, check, key))
    doc, row, key, check, start, n = (v[turn] for v in (doc, row, key, check, start, n))
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key | np.concatenate([[True], check[1:] != check[:-1]])
    gone = doc > doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
    yield _told(*(v[gone] for v in (doc, row, start, n)), False)
    if ask:
        heads = np.flatnonzero(new_key)
        run = np.cumsum(new_key) - 1
        stretches = np.add.reduceat(new.astype(np.int64), heads)[run]
        several = np.minimum.reduceat(doc, heads)[run] < np.maximum.reduceat(doc, heads)[run]
        wanted = ~gone & (stretches > 1) & several
        yield _told(*(v[wanted] for v in (doc, row, start, n)), True)


def _met(ask: bool, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held, count = [], 0
        for batch in batches:
            lists = [batch.column(c) for c in range(1, 8)]
            decided = batch.column(8).to_numpy(zero_copy_only=False)
            for pick in (True, False):
                rows = pa.array(np.flatnonzero(decided == pick))
                doc, row, each, key, check, start, n = (x.take(rows).flatten().to_numpy() for x in lists)
                if not len(doc):
                    continue
                record = [np.repeat(doc, each), np.repeat(row, each), key.view(np.uint64), check.view(np.uint64), start, n]
                if pick:
                    yield _told(*record[:2], *record[4:], False)
                elif ask and count > most:
                    yield _told(*record[:2], *record[4:], True)
                else:
                    held.append(record)
                    count += len(key)
            if ask and count > most and held:  # too many to be held: all of their windows are compared
                for record in held:
                    yield _told(*record[:2], *record[4:], True)
                held = []
        if held:
            yield from repeats(*(np.concatenate(c) for c in zip(*held)), ask)

    return run


def _cut(window: int):
    """Rows (doc, row, copies, data, start, n) to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for data, start, n in zip(batch.column("data"), batch.column("start"), batch.column("n")):
                own = data.as_buffer().to_pybytes().split()
                n_words.append(len(own))
                if start.is_valid and len(start):
                    low, high = np.asarray(start.values, np.int64), np.asarray(n.values, np.int64)
                    step = np.zeros(len(own) + 1, np.int64)
                    np.add.at(step, low, 1)
                    np.add.at(step, low + high - 1 + window, -1)
                    own = list(compress(own, np.cumsum(step)[:-1] == 0))
                n_removed.append(n_words[-1] - len(own))
                kept.append(b" ".join(own).decode("utf-8", "replace"))
            columns = [*(batch.column(k) for k in range(3)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "row", "copies", "n_words", "n_removed", "kept"])
            give_back()

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, most_held: int = MOST_HELD) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept (the remaining words, joined by one space).

    Null texts have no words. Rows that repeat id and text are one document and get the same result each; rows with the same id
    and another text are documents of which neither is smaller; rows without an id are larger than all others and none is smaller
    than another of them. A window that stands twice in one document is no repeat for that. An empty table gives no rows; other
    columns are not read. period: at most `window`; a larger one has fewer anchors, of fewer words each."""
    if not 1 <= period <= window:
        raise ValueError("the period must be between one word and the window")
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(8, math.ceil(total / bucket_bytes))
    data = lambda df, *more: df.select("doc", "row", *more, F.encode("text", "UTF-8").alias("data"))
    met = data(named).mapInArrow(dealt(buckets, window, period), DEALT).groupBy("bucket").applyInArrow(_met(True, most_held), RANGES)
    met = materialize(met)
    # One row per document: repeated rows are counted before the texts are dealt, and both joins read the same exchange.
    unique = named.groupBy("doc", "row").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    ranges = lambda df: df.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("r")).select("doc", "row", F.col("r.start").alias("start"), F.col("r.n").alias("n"))
    wanted = unique.join(ranges(met.where("asked")), ["doc", "row"]).select("doc", "row", F.encode("text", "UTF-8").alias("data"), "start", "n", "copies")
    again = wanted.mapInArrow(dealt(buckets, window, None), DEALT).groupBy("bucket").applyInArrow(_met(False, most_held), RANGES)
    gone = ranges(met.where("not asked").unionByName(again))
    left = data(unique.join(gone, ["doc", "row"], "left"), "copies", "start", "n")
    cut = left.select("doc", "row", "copies", "data", "start", "n").mapInArrow(_cut(window), "doc long, row long, copies long, n_words long, n_removed long, kept string")
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("copies") - 1, F.lit(1024))))
    each = cut.withColumn("_k", some).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1024).cast("long"), F.col("copies") - F.col("_k") * 1024))))
    return each.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, windows of 50 words."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(doc_id, {NO_ID}) as doc, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
k as (
  select r, doc, unnest(range(1, len(w) - {WINDOW - 2})) as i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')))) as h
  from d where len(w) >= {WINDOW}),
m as (select h, min(doc) as least from k group by h),
s as (select r, i from k join m using (h) where doc > least),
words as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
g as (
  select r, i, word, max((s.i is not null)::int) over (partition by r order by i rows between {WINDOW - 1} preceding and current row) as gone
  from words left join s using (r, i)),
kept as (select r, sum(gone)::bigint as n_removed, string_agg(word, ' ' order by i) filter (gone = 0) as kept from g group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (r)
"""
