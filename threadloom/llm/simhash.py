"""SimHash near-dedup with deletion-variant signatures.

Fingerprints of 64 bits that differ in at most two bits are cut into two segments, so that one segment differs in at most one
bit. For each segment and each of its bits, the variant with that bit wiped is a signature; two fingerprints within reach have a
signature in common. Signatures meet through hash partitioning, candidates are verified on all 64 bits, and links are
reduced to a spanning forest before they leave a task, so a large group of copies costs its size and not its square.

A signature that too many fingerprints share is dealt again with a third of the other segment's bits added, of which one must be
equal, too, and so on down a tree of thirds. At its end 11 bits are left that may differ, so no group is above 2048."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import HOT_KEYS, bound_batches, connected_components, give_back, look_up, materialize, spans_at_space

WORDS, SEED, MOST_BITS = 3, 42, 2
#: Signatures shared by more fingerprints are dealt again, by thirds of the bits that may still differ, DEPTH times at most.
HOT, DEPTH = 2048, 3
#: Stands for the id of documents without one, after all others.
NO_ID = 2**63 - 1
#: Signatures are counted by so many hash values to find those that would crowd one task.
COUNTED = 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """SimHash of a whole UTF-8 text as an unsigned integer; zero without words."""
    counts, total, carry = np.zeros(64, np.int64), 0, []
    for part in spans_at_space(data):
        tokens = carry + part.lower().split()
        n = len(tokens) - words + 1
        if n > 0:
            hashes = np.fromiter(map(_hash, map(b" ".join, zip(*(tokens[i:] for i in range(words))))), np.uint64, n)
            counts += _bit_counts(hashes)
            total += n
        carry = tokens[-(words - 1) :] if words > 1 else []
    if not total:
        if not carry:
            return 0
        counts, total = _bit_counts(np.asarray([_hash(b" ".join(carry))], np.uint64)), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, row, fp): row is a hash of the text, fp the fingerprint as a signed long of the same bits. A null text has no words."""

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes(), words) if x.is_valid else 0 for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.asarray(found, np.uint64).view(np.int64))], names=["doc_id", "row", "fp"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _row(text_col).alias("row"), F.encode(F.col(text_col), "UTF-8").alias("data")).mapInArrow(run, "doc_id long, row long, fp long")


def _row(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """The pairs that join two trees of the forest kept in `parent`."""
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = x, y
        while (p := parent.get(u, u)) != u:
            parent[u] = parent.get(p, p)
            u = p
        while (p := parent.get(v, v)) != v:
            parent[v] = parent.get(p, p)
            v = p
        if u != v:
            parent[u] = v
            out.append((x, y))
    return out


def _pairs(keys: np.ndarray, fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs within runs of equal keys, by distance between places in the run."""
    at = np.arange(len(keys))
    for step in range(1, len(keys)):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            return
        # Unsigned: of a negative number, bitwise_count would count the bits of its absolute value.
        near = at[np.bitwise_count((fps[at] ^ fps[at + step]).view(np.uint64)) <= most]
        if len(near):
            yield fps[near], fps[near + step]


def _link(most: int, hot: int | None):
    """Rows come in order of (sig, part). A run of at most `hot` rows gives its links (a, b); of a longer one every row comes back
    as (a = sig, b = fp, c = part), to be dealt again, and is not held. Without `hot` every run gives its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_fps, crowded = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), None
        parent: dict[int, int] = {}

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            number = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]) if len(keys) else np.zeros(0, int)
            size = np.bincount(number)[number] if len(keys) else number
            again = size > hot if hot else np.zeros(len(keys), bool)
            if crowded is not None:
                again |= (keys == crowded).all(axis=1)
            found = [p for a, b in _pairs(number[~again], fps[~again], most) for p in _forest(a, b, parent)]
            columns = [np.concatenate([np.asarray([p[k] for p in found], np.int64), rest[again]]) for k, rest in ((0, keys[:, 0]), (1, fps))]
            part = pa.array(np.concatenate([np.zeros(len(found), np.int64), keys[again, 1]]), mask=np.arange(len(columns[0])) < len(found))
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), part], names=["a", "b", "c"])

        for batch in batches:
            keys = np.concatenate([held_keys, np.stack([batch.column("sig").to_numpy(), batch.column("part").to_numpy()], axis=1)])
            fps = np.concatenate([held_fps, batch.column("fp").to_numpy()])
            if not len(keys):
                continue
            last = int(np.flatnonzero((keys == keys[-1]).all(axis=1))[0])
            if hot and len(keys) - last > hot:  # this run is dealt again, whatever follows: nothing of it is held
                last = len(keys)
            held_keys, held_fps = keys[last:], fps[last:]
            yield links(keys[:last], fps[:last])
            crowded = keys[-1] if last == len(keys) else None if crowded is None or (keys[-1] != crowded).any() else crowded
        yield links(held_keys, held_fps)
        parent.clear()
        give_back()

    return run


def _thirds(depth: int = DEPTH, width: int = 32) -> list[int]:
    """Masks over the bits of a segment, node by node of a tree in which the children of k are 3k + 1 to 3k + 3: each adds a third
    of the bits that its parent leaves out."""
    masks = [0]
    for k in range((3**depth - 1) // 2):
        free = [b for b in range(width) if not masks[k] >> b & 1]
        masks += [masks[k] | sum(1 << b for b in part.tolist()) for part in np.array_split(free, 3)]
    return masks


def _children(rows: DataFrame) -> DataFrame:
    """Rows (sig, part, fp) under the three parts below theirs; part holds the number of its node and the bits that are fixed."""
    masks = F.array(*[F.lit(m).cast("long") for m in _thirds()])
    rest = F.expr("case when shiftrightunsigned(sig, 37) = 0 then shiftrightunsigned(fp, 32) else fp & 4294967295 end")
    node = F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: 3 * F.shiftrightunsigned("part", 32) + k))
    dealt = rows.withColumn("rest", rest).withColumn("node", node)
    return dealt.select("sig", (F.col("node") * 4294967296 + F.col("rest").bitwiseAND(F.element_at(masks, (F.col("node") + 1).cast("int")))).alias("part"), "fp")


def links(fps: DataFrame, most: int = MOST_BITS, hot: int = HOT) -> DataFrame:
    """A spanning set of links (a, b) between distinct fingerprints that differ in at most `most` = 2 bits.

    At each depth, signatures that would crowd a task (a HOT_KEYS-th of all rows or more by the count of their hash value, of which
    there are HOT_KEYS at most) go on to the next depth before they are dealt; those that prove crowded where they were dealt
    follow. No signature is left out."""
    if most != 2:
        raise ValueError("two segments with one wildcard each cover exactly two differing bits")
    distinct = fps.select("fp").distinct()
    wiped = F.expr("(shiftrightunsigned(fp, cast(i div 32 * 32 as int)) & 4294967295) & ~shiftleft(1L, i % 32)")
    signed = distinct.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    todo = signed.select((F.col("i").cast("long") * 4294967296 + wiped).alias("sig"), F.lit(0).cast("long").alias("part"), "fp")
    found = []
    for depth in range(DEPTH + 1):
        later = None
        if depth < DEPTH:
            value = F.pmod(F.xxhash64("sig", "part"), F.lit(COUNTED))
            counts = todo.groupBy(value.alias("v")).count()
            total = counts.agg(F.sum("count")).first()[0] or 0
            if not total:
                break
            crowd = [r["v"] for r in counts.where(F.col("count") >= max(hot, total / HOT_KEYS)).collect()]  # HOT_KEYS at most
            if crowd:
                later, todo = todo.where(value.isin(crowd)), todo.where(~value.isin(crowd))
        dealt = todo.repartition("sig", "part").sortWithinPartitions("sig", "part", "fp")
        out = materialize(dealt.mapInArrow(_link(most, hot if depth < DEPTH else None), "a long, b long, c long"))
        found.append(out.where("c is null").select("a", "b"))
        again = out.where("c is not null").select(F.col("a").alias("sig"), F.col("c").alias("part"), F.col("b").alias("fp"))
        todo = _children(again if later is None else again.unionByName(later))
    return reduce(DataFrame.unionByName, found) if found else distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b"))


def _classes(marked: DataFrame) -> DataFrame:
    """(fp, n, doc_id, row): per fingerprint, how many documents have it and the first row of the smallest component it is in."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    classes = materialize(marked.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")))
    parts = connected_components(links(classes))
    joined = materialize(classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    smallest = materialize(joined.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("members")))
    named = look_up(joined.select("fp", "n", "component"), smallest, "component", "members")
    return named.select("fp", "n", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("component_row"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included).

    Equal fingerprints are one node, so a group of copies of any size is one row in the search. Null or wordless texts have
    fingerprint zero and link like others; the component of documents without any id is null; repeated rows stay; an
    empty table gives no rows; other columns are not read."""
    marked = materialize(fingerprints(docs, id_col, text_col))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return look_up(marked, materialize(_classes(marked)), "fp", "n").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which one per group of near duplicates stays: the smallest id.

    A row is known by its id and a hash of its text, so rows that share an id but not the text are separate documents (ordered by
    that hash), and rows that repeat both are one. Documents without an id come after all others."""
    kept = _classes(materialize(fingerprints(docs, id_col, text_col))).select(F.coalesce("component_id", F.lit(NO_ID)).alias("_id"), F.col("component_row").alias("_row")).distinct()
    keyed = docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("_row", _row(text_col))
    return keyed.join(kept, ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).drop("_id", "_row")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
