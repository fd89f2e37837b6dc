"""Exact substring dedup on a suffix array built by two-stage sorting.

A byte goes if a LENGTH-byte string that covers it also starts earlier, in a smaller document id or earlier in the same document.

1. Every window of LENGTH bytes has a leftmost smallest gram; equal windows have it at the same place. A document thus falls into
   anchors, each with a run of window starts. Only fixed-size records of the anchors travel, packed by gram. Anchors whose gram
   is nowhere else hold no repeated window and end here.
2. Anchors with one gram whose whole stretch of text is the same (by 96 bits of two independent hashes of it, beside the 64 of its gram) are one string; all but
   the earliest are repeats. Where a gram stands in different stretches, the earliest of each sends its bytes to the gram's
   group. A gram in very many stretches is told apart by more context: its windows are dealt in CLASSES by where the gram
   stands in them, and grouped by the bytes that all windows of a class share.
3. A group's suffixes are sorted in two stages: those smaller than their successors directly, the rest induced by scanning the
   buckets in order. Adjacent common prefixes of LENGTH bytes form the runs of equal windows; all but a run's earliest are repeats.
4. Repeats are gathered per document, merged into spans and cut out.

Groups are keyed by content, so equal windows always meet, and nothing depends on how documents are dealt to tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bound_batches, give_back, materialize

LENGTH, GRAM, SLACK = 100, 24, 16
WINDOW = LENGTH - GRAM + 1
#: Text bytes whose anchors share one group, text bytes hashed at a time, text bytes packed at a time.
BUCKET_BYTES, GROUP_BYTES, PART_BYTES = 16 << 20, 1 << 19, 1 << 23
#: Groups of stretches that are sorted, for each bucket of anchors.
PARTS = 4
#: Grams in more different stretches are dealt by context; classes of windows by the place of the gram in them.
HOT_GRAM, CLASSES = 2048, 4
#: The place in the order of documents without an id.
NO_ID = 2**63 - 1

RANGES = "doc long, row long, start int, n int, gram long, at int"


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes that start at each place."""
    size = len(x) - GRAM + 1
    words = np.ndarray((len(x) - 7,), "<u8", x.data, 0, (1,))
    h = words[:size] * np.uint64(0x9E3779B97F4A7C15)
    for k, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0xD6E8FEB86659FD93)):
        h ^= h >> np.uint64(31)
        h += words[k : k + size]
        h *= np.uint64(odd)
    h ^= h >> np.uint64(32)
    return h


def window_minima(h: np.ndarray) -> np.ndarray:
    """Place of the leftmost smallest hash among the WINDOW places from each start, by doubling."""
    value, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        left, right = value[:-step], value[step:]
        smaller = right < left
        at = np.where(smaller, at[step:], at[:-step])
        value = np.where(smaller, right, left)
        width += step
    return at


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, first window start, windows, gram hash, two hashes of the stretch, place of the gram) of every anchor, in order."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    x = np.frombuffer(b"".join(texts), np.uint8)
    if not len(x) or sizes.max(initial=0) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint32, np.uint64, np.uint8))
    h = gram_hashes(x)
    at = window_minima(h)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    fits = np.flatnonzero(np.arange(len(at)) + LENGTH <= ends[owner])
    at, owner = at[fits], owner[fits]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    n = np.diff(np.concatenate([first, [len(at)]]))
    low, owner, gram = fits[first], owner[first], h[at[first]]
    last = low + n - 1 + LENGTH - GRAM
    stretch = n.astype(np.uint64)
    for k in range(-(-(WINDOW + LENGTH) // GRAM)):
        stretch = (stretch ^ (stretch >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[np.minimum(low + k * GRAM, last)]
    # The second one reads the bytes themselves, eight at a time, the last eight last.
    words = np.ndarray((len(x) - 7,), "<u8", x.data, 0, (1,))
    second, last = n.astype(np.uint64), low + n - 1 + LENGTH - 8
    for k in range(-(-(WINDOW + LENGTH) // 8)):
        second = (second ^ (second >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + words[np.minimum(low + 8 * k, last)] * np.uint64(0x9E3779B97F4A7C15)
    return owner, low - (ends - sizes)[owner], n, gram, (stretch >> np.uint64(32)).astype(np.uint32), second, (at[first] - low).astype(np.uint8)


def _pack(keep: tuple, gone: tuple, doc: np.ndarray, row: np.ndarray) -> bytes:
    (own, start, n, gram, stretch, second, at), (own2, start2, n2) = keep, gone
    used = np.union1d(own, own2)
    counts = [np.bincount(np.searchsorted(used, o), minlength=len(used)) for o in (own, own2)]  # anchors are in order of their texts
    width = 2 if max(c.max(initial=0) for c in counts) < 1 << 16 else 4
    parts = [np.array([len(own), len(own2), len(used), width], "<i8"), gram, second, doc[used], row[used], stretch, np.concatenate([start, start2]).astype("<i4"), *(c.astype(f"<u{width}") for c in counts), np.concatenate([n, n2]).astype("u1"), at]
    return b"".join(p.tobytes() for p in parts)


def _unpack(data: bytes | pa.Buffer) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(gram, stretch, second, doc, row, start, n, at) of the anchors that were kept, (doc, row, start, n) of the repeats."""
    a, b, used, width = np.frombuffer(data, "<i8", 4)
    at, out = 32, []
    for kind, size in (("<u8", a), ("<u8", a), ("<i8", used), ("<i8", used), ("<u4", a), ("<i4", a + b), (f"<u{width}", used), (f"<u{width}", used), ("u1", a + b), ("u1", a)):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    gram, second, doc, row, stretch, start, kept, gone, n, place = out
    number = np.concatenate([np.repeat(np.arange(used), kept), np.repeat(np.arange(used), gone)])
    every = doc[number], row[number], start, n
    return (gram, stretch, second, *(v[:a] for v in every), place), tuple(v[a:] for v in every)


def _dealt(buckets: int):
    """Documents (doc, row, data) to packed anchors by bucket; repeats within a part of a batch are marked at once."""

    def packed(found: list[tuple], doc: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        own, start, n, gram, stretch, second, place = (np.concatenate(c) for c in zip(*found))
        turn = np.lexsort((second, stretch, gram))  # stable: the first of equal stretches comes first
        keep = np.ones(len(own), bool)
        keep[turn[1:]] = (gram[turn][1:] != gram[turn][:-1]) | (stretch[turn][1:] != stretch[turn][:-1]) | (second[turn][1:] != second[turn][:-1])
        # Repeats are decided and go wherever there is room, by their document, not to the bucket of a gram that may be hot.
        anywhere = ((doc.view(np.uint64) ^ row.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32))[own]
        bucket = np.where(keep, gram >> np.uint64(32), anywhere).astype(np.int64) % buckets
        turn = np.argsort(bucket, kind="stable")
        there, cuts = np.unique(bucket[turn], return_index=True)
        out = []
        for b, at in zip(there.tolist(), np.split(turn, cuts[1:])):
            if len(at):
                k, g = at[keep[at]], at[~keep[at]]
                out.append((b, _pack(tuple(v[k] for v in (own, start, n, gram, stretch, second, place)), tuple(v[g] for v in (own, start, n)), doc, row)))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            order = np.lexsort((row, doc))
            # A row that repeats id and text is the same document.
            order = order[np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(row[order]) != 0)])] if len(order) else order
            doc, row = doc[order], row[order]  # texts are numbered in this order from here on, so anchors come in order of their numbers
            found, texts, numbers, held, since = [], [], [], 0, 0
            data = batch.column("data")
            for k, i in enumerate(order.tolist()):
                texts.append(data[i].as_buffer().to_pybytes())
                numbers.append(k)
                held += len(texts[-1])
                last = k == len(order) - 1
                if held >= GROUP_BYTES or last:
                    own, *rest = anchors(texts)
                    found.append((np.asarray(numbers)[own], *rest))
                    since += held
                    texts, numbers, held = [], [], 0
                if found and (since >= PART_BYTES or last):
                    yield packed(found, doc, row)
                    found, since = [], 0
            del data, batch
            give_back()

    return run


def _ranges(doc, row, start, n, gram, at=None) -> pa.Table:
    kinds = (np.int64, np.int64, np.int32, np.int32)
    columns = [pa.array(np.ascontiguousarray(v, t)) for v, t in zip((doc, row, start, n), kinds)]
    columns += [pa.array(gram, pa.int64()) if gram is not None else pa.nulls(len(doc), pa.int64()), at if at is not None else pa.nulls(len(doc), pa.int32())]
    return pa.table(columns, names=["doc", "row", "start", "n", "gram", "at"])


def _matched(hot: int):
    def run(group: pa.Table) -> pa.Table:
        return _of_bucket(hot, group)

    return run


def _of_bucket(hot: int, group: pa.Table) -> pa.Table:
    """Of one bucket: repeats (gram null), and the stretches whose bytes are wanted (gram set; at set, too, where the gram stands
    in more than `hot` stretches)."""
    give_back()
    packed = [x.as_buffer() for x in group.column("packed").combine_chunks()]
    grams = np.concatenate([_unpack(x)[0][0] for x in packed])
    turn = np.argsort(grams, kind="stable")
    same = grams[turn][1:] == grams[turn][:-1]
    often = np.zeros(len(grams), bool)
    often[turn[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] = True
    del turn, same, grams
    gone, kept, at = [], [], 0
    for x in packed:  # only anchors whose gram is there twice are unpacked
        keep, lost = _unpack(x)
        gone.append(_ranges(*lost, None))
        mask = often[at : at + len(keep[0])]
        kept.append(tuple(v[mask] for v in keep))
        at += len(mask)
    gram, stretch, second, doc, row, start, n, place = (np.concatenate(c) for c in zip(*kept))
    if not len(gram):
        return pa.concat_tables(gone)
    turn = np.lexsort((start, row, doc, second, stretch, gram))
    gram, stretch, second, doc, row, start, n, place = (v[turn] for v in (gram, stretch, second, doc, row, start, n, place))
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    first = new_gram | np.concatenate([[True], (stretch[1:] != stretch[:-1]) | (second[1:] != second[:-1])])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    elsewhere = (doc != doc[head]) | (row != row[head]) | (start != start[head])  # else a row that repeats id and text
    gone.append(_ranges(*(v[elsewhere] for v in (doc, row, start, n)), None))
    stretches = np.bincount(np.cumsum(new_gram)[first] - 1)[np.cumsum(new_gram) - 1]
    ask = first & (stretches > 1)
    gone.append(_ranges(*(v[ask] for v in (doc, row, start, n)), gram[ask].view(np.int64), pa.array(place[ask].astype(np.int32), mask=stretches[ask] <= hot)))
    return pa.concat_tables(gone)


def _wanted(asked: DataFrame, data: DataFrame, parts: int) -> DataFrame:
    """(doc, row, start, n, bytes, part): the asked stretches with their bytes and SLACK more, dealt by gram.

    Carried columns of `data` are named here, to no effect, so that they stay in the exchange of the texts, which the last join
    then reads again instead of dealing the texts once more.

    A stretch of a hot gram comes in up to CLASSES pieces: a piece has the windows in which the gram stands from `low` to `high`,
    and is dealt by the bytes that all such windows have around the gram, whatever their place: equal windows still meet."""
    edges = [k * WINDOW // CLASSES for k in range(CLASSES + 1)]
    piece = lambda low, high: F.expr(f"struct(greatest(start, start + at - {high}) as start, least(start + n - 1, start + at - {low}) as last, start + at - {low} as core, {LENGTH + low - high} as core_n)")
    pieces = F.filter(F.array(*[piece(low, high - 1) for low, high in zip(edges, edges[1:])]), lambda p: p["start"] <= p["last"])
    whole = F.array(F.expr("struct(start, start + n - 1 as last, start as core, 0 as core_n)"))
    cut = asked.withColumn("p", F.explode(F.when(F.col("at").isNull(), whole).otherwise(pieces))).select("doc", "row", "gram", "p.*")
    text = data.join(cut, ["doc", "row"])
    key = F.xxhash64("gram", F.expr("core_n"), F.expr("substring(data, core + 1, core_n)"))
    carried = [c for c in data.columns if c not in ("doc", "row", "data")]
    key = key.bitwiseXOR(F.xxhash64(*carried).bitwiseAND(F.lit(0))) if carried else key
    stretch = F.expr(f"substring(data, start + 1, last - start + {LENGTH + SLACK})")
    return text.select("doc", "row", "start", F.expr("last - start + 1").cast("int").alias("n"), stretch.alias("bytes"), F.pmod(key, F.lit(parts)).alias("part"))


def _keys(symbols: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` symbols of each suffix as fixed-size strings that compare like the suffixes; what follows an end is 0."""
    wide = symbols.max() > 255
    out = np.empty((len(places), depth), ">u2" if wide else "u1")
    lane = np.arange(depth)
    for i in range(0, len(places), 8192):
        rows = symbols[np.minimum(places[i : i + 8192, None] + lane, len(symbols) - 1)]
        rows[np.maximum.accumulate(rows == 0, axis=1)] = 0
        out[i : i + 8192] = rows
    return out.view(f"S{depth * out.itemsize}").ravel()


def two_stage_sort(symbols: np.ndarray, head: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of the wanted places of texts that each end with symbol 0, in order of their first `depth` symbols at least.

    symbols: texts one after the other, values up to 256; head: true where a text starts. A suffix that is smaller than its
    successor (and every end) is sorted directly; any other is put behind its bucket's earlier ones when the scan meets its
    successor. Only wanted suffixes and those that induce them are touched."""
    size = len(symbols)
    following = np.concatenate([symbols[1:], np.zeros(1, symbols.dtype)])
    # Type by the next different symbol of the same text: ends are the smallest, so runs never cross them.
    change = np.flatnonzero(symbols != following)
    runs = np.diff(np.concatenate([[-1], change]))
    after = np.full(size, -1, np.int16)
    after[: int(runs.sum())] = np.repeat(following[change], runs)
    direct = (symbols == 0) | (after > symbols)
    del after, runs, change
    # A wanted suffix of the other kind needs its successors up to the next direct one.
    touched = np.zeros(size + 1, np.int32)
    stops = np.flatnonzero(direct)
    places = np.flatnonzero(wanted)
    np.add.at(touched, places, 1)
    np.add.at(touched, stops[np.searchsorted(stops, places)] + 1, -1)
    needed = np.cumsum(touched, dtype=np.int32)[:-1] > 0
    del touched, places, stops, following
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    result = []
    sorted_direct = np.flatnonzero(direct & needed)
    by_symbol = np.argsort(symbols[sorted_direct], kind="stable")
    cuts = np.searchsorted(symbols[sorted_direct][by_symbol], np.arange(258))
    for c in range(257):
        part = [np.concatenate(induced[c])] if induced[c] else []
        front = part[0] if part else np.zeros(0, int)
        while len(front):
            front = front[~head[front]] - 1
            front = front[(symbols[front] == c) & needed[front]]
            part.append(front)
        own = sorted_direct[by_symbol[cuts[c] : cuts[c + 1]]]
        if c and len(own) > 1:
            own = own[np.argsort(_keys(symbols, own, depth), kind="stable")]
        order = np.concatenate([*part, own])
        result.append(order[wanted[order]])
        before = order[~head[order]] - 1
        before = before[(symbols[before] > c) & needed[before]]
        turn = np.argsort(symbols[before], kind="stable")
        values, starts = np.unique(symbols[before][turn], return_index=True)
        for v, chunk in zip(values.tolist(), np.split(before[turn], starts[1:])):
            induced[v].append(chunk)
    return np.concatenate(result)


def equal_neighbours(symbols: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of a suffix array but the first: whether its common prefix with the one before has `length` symbols."""
    out, lane = np.zeros(max(0, len(order) - 1), bool), np.arange(length)
    for i in range(0, len(out), 16384):
        a, b = order[i : min(i + 16384, len(out))], order[i + 1 : i + 16385]
        out[i : i + len(b)] = (symbols[a[:, None] + lane] == symbols[b[:, None] + lane]).all(axis=1)
    return out


def _sorted_repeats(group: pa.Table) -> pa.Table:
    """Of the stretches of one group: the windows that are equal to an earlier one of another stretch."""
    give_back()
    doc, row, start, n = (group.column(c).to_numpy() for c in ("doc", "row", "start", "n"))
    turn = np.lexsort((start, row, doc))
    again = (np.diff(doc[turn]) == 0) & (np.diff(row[turn]) == 0) & (np.diff(start[turn]) == 0)
    turn = turn[np.concatenate([[True], ~again])]  # rows that repeat id and text send the same stretch
    doc, row, start, n = (v[turn] for v in (doc, row, start, n))
    texts = group.column("bytes").combine_chunks().take(pa.array(turn))
    texts = [t.as_buffer().to_pybytes() for t in texts]
    sizes = np.array([len(t) for t in texts]) + 1
    heads = np.cumsum(sizes) - sizes
    symbols = np.zeros(int(sizes.sum()), np.int16)
    inside = np.ones(len(symbols), bool)
    inside[heads + sizes - 1] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    head = np.zeros(len(symbols), bool)
    head[heads] = True
    owner = np.repeat(np.arange(len(texts)), n)
    places = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + heads[owner]
    wanted = np.zeros(len(symbols), bool)
    wanted[places] = True
    whose = np.zeros(len(symbols), np.int64)
    whose[places] = owner
    order = two_stage_sort(symbols, head, wanted, LENGTH + SLACK)
    equal = equal_neighbours(symbols, order)
    run = np.concatenate([[0], np.cumsum(~equal)])
    text = whose[order]
    earliest = np.minimum.reduceat(text, np.flatnonzero(np.concatenate([[True], ~equal])))
    repeated = order[text > earliest[run]]
    repeated.sort()
    if not len(repeated):
        return _ranges(*(np.zeros(0, int),) * 4, None)
    opens = np.flatnonzero(np.concatenate([[True], np.diff(repeated) != 1]))
    k = whose[repeated[opens]]
    return _ranges(doc[k], row[k], start[k] + repeated[opens] - heads[k], np.diff(np.concatenate([opens, [len(repeated)]])), None)


def _cut(as_text: bool):
    """Rows (doc, row, data, carried columns, ranges) to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for data, ranges in zip(batch.column("data"), batch.column("ranges")):
                text, spans = data.as_buffer().to_pybytes(), []
                if ranges.is_valid and len(ranges):
                    starts = ranges.values.field("start").to_numpy().astype(np.int64)
                    ends = starts + ranges.values.field("n").to_numpy() + LENGTH - 1
                    turn = np.argsort(starts, kind="stable")
                    starts, ends = starts[turn], np.maximum.accumulate(ends[turn])
                    opens = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
                    spans = list(zip(starts[opens].tolist(), ends[np.concatenate([opens[1:] - 1, [len(ends) - 1]])].tolist()))
                parts, at = [], 0
                for a, b in spans:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                left = b"".join(parts)
                n_bytes.append(len(text))
                n_removed.append(len(text) - len(left))
                n_spans.append(len(spans))
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            known = [batch.column(k) for k in range(batch.num_columns - 1) if k != 2]
            names = [batch.schema.names[k] for k in range(batch.num_columns - 1) if k != 2]
            columns = [*known, *(pa.array(v, pa.int64()) for v in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc, row, data): the id (rows without one come last), a hash that tells rows of one id apart, the UTF-8 bytes."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"), *[F.col(c).alias(f"_{c}") for c in carry])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot: int = HOT_GRAM, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per row of `docs`: doc, row, n_bytes, n_removed, n_spans, kept (the remaining bytes),
    and the columns named by `carry` with an underscore before their names. With `as_text`, kept is a string; what is left of a
    character that a cut went through is dropped.

    Null texts are empty. Rows that repeat both id and text are one document and get the same result each; rows with the same
    id and other text are separate documents, ordered by a hash of the text; rows without an id come after all others. An
    empty table gives no rows. Other columns are not read."""
    bound_batches(docs.sparkSession)
    marked = identified(docs, id_col, text_col, carry)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(4, math.ceil(total / bucket_bytes))
    packed = marked.select("doc", "row", "data").mapInArrow(_dealt(buckets), "bucket int, packed binary")
    matched = materialize(packed.groupBy("bucket").applyInArrow(_matched(hot), RANGES))
    repeats = _wanted(matched.where("gram is not null"), marked, buckets * PARTS).groupBy("part").applyInArrow(_sorted_repeats, RANGES)
    ranges = matched.where("gram is null").unionByName(repeats).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    joined = marked.join(ranges, ["doc", "row"], "left")
    schema = joined.drop("data", "ranges").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string" if as_text else "binary")
    return joined.mapInArrow(_cut(as_text), schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str, hot: int = HOT_GRAM) -> DataFrame:
    """All documents, strings of 100 bytes."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), hot=hot)
    return found.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
