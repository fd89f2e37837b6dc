"""Best-fit packing of tokenized documents into sequences, by linear grouping.

Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver. There, large lengths are put into groups
of equal cardinality and rounded up to the largest of their group, the linear program over configurations of these few sizes
is solved by column generation, real lengths replace the rounded ones, and what is left, small lengths above all, goes into the
tightest gap. The plan says how many sequences have which lengths at which offsets; a piece finds its place through its rank
among the pieces of its length, which is a distributed prefix sum."""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import bound_batches, give_back, materialize, spans_at_space

CAPACITY = 2048
END_ID = 0
#: Documents of at least capacity / LARGE_PART tokens are grouped; the others are best-fitted at the end.
LARGE_PART, GROUPS = 8, 24
#: Configurations filled to within so many tokens are kept as they are.
TIGHT = 16
#: Pieces of one length that are ranked in one task, on average, when all pieces have that length.
RANK_ROWS = 1 << 16
CACHE_WORDS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

class WordEncoder:
    """Token ids of white-space separated chunks, the same as the tokenizer file's own, kept for words seen before.

    Where lower-casing, pattern and merges never look across white space, ids of a text are those of its chunks in turn. Chunks
    of Latin letters go through a rank table built from the same vocabulary, in which the marker byte 2 stands for the word
    end; any other chunk goes to the tokenizer itself. Pattern and word end are read from the file; a file that is not built
    this way is left to the tokenizer, whole texts at a time."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        pattern, end = _word_rules(path)
        self.by_chunk = pattern is not None
        if not self.by_chunk:
            return
        byte_of = {c: b for b, c in _printable_bytes().items()}
        ranks = {}
        self.ends_word = np.zeros(self.slow.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.slow.get_vocab(with_added_tokens=False).items():
            ended = token.endswith(end)
            body = token.removesuffix(end)
            if all(c in byte_of for c in body):
                ranks[bytes(byte_of[c] for c in body) + b"\x02" * ended] = i
                self.ends_word[i] = ended
        self.fast = tiktoken.Encoding("words", pat_str="[^\x02]+\x02", mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.plain = regex.compile(r"[\x21-\x7E¡-ɏ]+")

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        plain, texts = [], []
        for c in chunks:
            s = c.decode("utf-8", "replace")
            if self.plain.fullmatch(s) and "<|" not in s:
                plain.append(c)
                texts.append("".join([p + "\x02" for p in self.pattern.findall(s.lower())]))
            else:
                self.known[c] = np.asarray(self.slow.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        ids = np.asarray(self.fast.encode_ordinary("".join(texts)), "<u4")
        word_ends = np.flatnonzero(self.ends_word[ids]) + 1
        chunk_ends = np.concatenate([[0], word_ends])[np.cumsum([t.count("\x02") for t in texts], dtype=np.int64)] if texts else []
        data, start = ids.tobytes(), 0
        for c, end in zip(plain, chunk_ends):
            self.known[c] = data[4 * start : 4 * end]
            start = end

    def encode(self, data: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not self.by_chunk:
            return np.asarray(self.slow.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for part in spans_at_space(data):
            words = part.split()
            new = set(words).difference(self.known)
            if new:
                self.learn(new)
                new = set(words).difference(self.known)  # the cache may have been emptied
                if new:
                    self.learn(new)
            out.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(out)


def _word_rules(path: str) -> tuple[str | None, str]:
    """(pattern, word end) of a tokenizer file that lower-cases, takes the words of a pattern that never holds white space, and
    merges their bytes in order of the merged tokens' ids; (None, "") for any other."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, norms = told["model"], (told.get("normalizer") or {}).get("normalizers", [])
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    usual = [n.get("type") for n in norms] == ["NFC", "Replace", "Lowercase"] and norms[1]["pattern"] == {"Regex": r"\s+"} and norms[1]["content"] == " "
    usual = usual and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    usual = usual and model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not usual or regex.search(steps[0]["pattern"].get("Regex", " "), " \t\n\r\x0b\x0c"):
        return None, ""
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"]["".join(p)] for p in pairs]
    return (steps[0]["pattern"]["Regex"], model["end_of_word_suffix"]) if ids == sorted(ids) else (None, "")


def _printable_bytes() -> dict[int, str]:
    """The usual byte alphabet of byte-level vocabularies: printable bytes stand for themselves, others from U+0100 on."""
    table, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[b] = chr(b)
        else:
            table[b] = chr(extra)
            extra += 1
    return table


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole texts, add the end id, cut what is longer than `capacity`: doc_id, piece, start, length, ids_crc32.

    A null text is empty and gives one piece of one id. Repeated rows give their pieces again. Other columns are not read."""
    bound_batches(docs.sparkSession)
    path = path or tokenizer_path()
    ended = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(data.as_buffer().to_pybytes() if data.is_valid else b"") + ended
                total = len(ids) // 4
                for k, start in enumerate(range(0, total, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(rows, (doc, k, start, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    binary = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("data"))
    return binary.mapInArrow(cut, PIECES)


# --- the plan, made from the histogram alone ---------------------------------------------------------------------------


def _groups(counts: np.ndarray, least: int, groups: int) -> list[tuple[int, int]]:
    """(largest length, documents) of each group of equal cardinality, longest first; lengths of one group count as its largest."""
    total = int(counts[least:].sum())
    size, out, room = -(-total // groups) if total else 0, [], 0
    for length in range(len(counts) - 1, least - 1, -1):
        left = int(counts[length])
        while left:
            if not room:
                out.append((length, 0))
                room = size
            take = min(left, room)
            out[-1] = (out[-1][0], out[-1][1] + take)
            left -= take
            room -= take
    merged: dict[int, int] = {}
    for length, n in out:
        merged[length] = merged.get(length, 0) + n
    return sorted(merged.items(), reverse=True)


def _configurations(sizes: list[int], needs: list[int], capacity: int) -> list[tuple[float, tuple[int, ...]]]:
    """Fractional optimum of the configuration program: (amount, items of each size), by column generation."""
    k = len(sizes)
    basis = np.zeros((k, k))
    for g, s in enumerate(sizes):
        basis[g, g] = capacity // s
    need = np.asarray(needs, float)
    order = np.asarray(sizes)
    for _ in range(40 * k):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(order.min()), capacity + 1):
            fits = order <= c
            value = np.where(fits, best[np.where(fits, c - order, 0)] + price, -1.0)
            g = int(value.argmax())
            if value[g] > best[c - 1] + 1e-12:
                best[c], pick[c] = value[g], g
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-6:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
                continue
            column[pick[c]] += 1
            c -= int(order[pick[c]])
        step, amount = inverse @ column, inverse @ need
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
    amount = np.linalg.solve(basis, need)
    return [(float(amount[j]), tuple(int(x) for x in basis[:, j])) for j in range(k)]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple[int, ...]]]:
    """Classes of sequences as (how many, lengths in order); every counted piece has one place, no sequence is over capacity."""
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    done: list[tuple[int, tuple[int, ...]]] = []
    if histogram[capacity]:
        done.append((int(histogram[capacity]), (capacity,)))
        histogram[capacity] = 0
    least = capacity // LARGE_PART
    grouped = _groups(histogram, least, groups)
    gaps: dict[int, list[list]] = defaultdict(list)  # gap: [how many, lengths]
    if grouped:
        sizes, needs = [g[0] for g in grouped], [g[1] for g in grouped]
        for amount, config in sorted(_configurations(sizes, needs, capacity), reverse=True):
            _substitute(histogram, [sizes[g] for g, a in enumerate(config) for _ in range(a)], int(amount + 1e-6), least, gaps, capacity)
    for gap in [g for g in gaps if g > TIGHT]:  # loose sequences give their documents back, to be fitted with the small ones
        for many, lengths in gaps.pop(gap):
            for x in lengths:
                histogram[x] += many
    _best_fit(histogram, gaps, capacity)
    for classes in gaps.values():
        done += [(n, lengths) for n, lengths in classes]
    return done


def _substitute(left: np.ndarray, slots: list[int], amount: int, least: int, gaps: dict[int, list[list]], capacity: int) -> None:
    """Put real lengths into `amount` sequences of one configuration: each slot takes the largest length left that its size
    covers, the last slot the largest that the sequence still holds. The class splits where a length runs out."""
    while amount > 0:
        lengths: list[int] = []
        for k, size in enumerate(slots):
            bound = capacity - sum(lengths) if k == len(slots) - 1 else size
            there = left[: bound + 1].copy()
            for x in lengths:
                if x <= bound:
                    there[x] -= 1
            fits = np.flatnonzero(there[least:] > 0)
            if not len(fits):
                break
            lengths.append(int(fits[-1]) + least)
        if not lengths:
            return
        many = min([amount, *(int(left[x]) // lengths.count(x) for x in set(lengths))])
        for x in lengths:
            left[x] -= many
        gaps[capacity - sum(lengths)].append([many, tuple(lengths)])
        amount -= many


def _best_fit(rest: np.ndarray, gaps: dict[int, list[list]], capacity: int) -> None:
    """Best-fit decreasing over classes: each length goes to the smallest gap that holds it, as often as the class has sequences."""
    open_gaps = sorted(g for g in gaps if g > 0)
    for length in range(len(rest) - 1, 0, -1):
        left = int(rest[length])
        while left:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):
                many, each = (left // (capacity // length), capacity // length) if left >= capacity // length else (1, left)
                new, lengths = capacity - each * length, (length,) * each
            else:
                gap = open_gaps[at]
                group = gaps[gap][-1]
                each = min(gap // length, left)
                many = min(group[0], left // each)
                new, lengths = gap - each * length, group[1] + (length,) * each
                group[0] -= many
                if not group[0]:
                    gaps[gap].pop()
                    if not gaps[gap]:
                        del gaps[gap]
                        open_gaps.pop(at)
            left -= many * each
            if new > 0 and new not in gaps:
                bisect.insort(open_gaps, new)
            gaps[new].append([many, lengths])


def places(classes: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys length << 40 | first rank, with the first sequence and the offset of each: rank r of a length goes to
    sequence first + (r - first rank)."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for many, lengths in classes:
        at = 0
        for length in lengths:
            rows.append((length << 40 | used[length], sequence, at))
            used[length] += many
            at += length
        sequence += many
    rows.sort()
    table = np.asarray(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Give every piece its sequence_id and offset. `cut` has the columns of `pieces`.

    Ranks within a length are taken inside (length, salt) and added to the salts' prefix sums, so one very frequent length is
    spread over as many tasks as its rows fill at RANK_ROWS each. An empty table gives no rows."""
    cut = materialize(cut)
    salts = max(64, -(-cut.count() // RANK_ROWS))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")
    salted = cut.withColumn("salt", spread)
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, firsts, offsets = places(plan(counts, capacity, groups))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("before", before).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("rank", rank).join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("salt", "before")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("length").to_numpy() << 40 | batch.column("rank").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            kept = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(firsts[at] + key - keys[at]), pa.array(offsets[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(put, PIECES + ", sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
