"""Sharding by fixed virtual slots: records hash into thousands of slots, slots map to shards through a versioned table.

The map is the only thing that rebalancing edits: a record's slot never changes. The map has one row per slot, a number
fixed by a parameter, so it may be held on the driver and broadcast whatever the size of the data.

A slot is a hash of id and text, so rows that share only one of them are dealt apart. Rows that repeat both would share a slot; one
that gets too large to be balanced is split: the map says so, and its rows are dealt over all slots by their place in the input
(rows that are alike may change places freely). Equal texts thus are in any shards: the law is that of bytes alone."""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialize, shared_dir

SLOTS = 4096
#: A slot is split where it has more rows than the first and more bytes than that part of an even shard.
SPLIT_ROWS, SPLIT_PART = 8, 1 / 16
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, rows long, split boolean"


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is dealt: the id as doc_id, size, text_crc32, record (a hash of id and text), place (in the input), one row per row, stored.

    The map and the assignment must see the same places, so where rows repeat give both the same records."""
    if {"record", "place", "text_crc32"} <= set(docs.columns):
        return docs
    text = F.coalesce(F.col(text_col), F.lit(""))
    return materialize(docs.select(F.col(id_col).alias("doc_id"), record_size(F.col(text_col)).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("record"), F.monotonically_increasing_id().alias("place")))


def virtual_slot(split: list[int], slots: int = SLOTS) -> Column:
    """The slot of a record: its hash, and where that slot is split a hash of it and its place."""
    first = F.pmod("record", F.lit(slots)).cast("int")
    return F.when(first.isin(split), F.pmod(F.xxhash64("record", "place"), F.lit(slots)).cast("int")).otherwise(first) if split else first


def slot_statistics(rows: DataFrame, split: list[int], slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that holds a record: at most `slots` rows, combined before the shuffle."""
    by = rows.groupBy(virtual_slot(split, slots).alias("slot")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return {r["slot"]: (r["bytes"], r["rows"]) for r in by.collect()}


def first_map(sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS, split: list[int] = []) -> list[tuple]:  # noqa: B006
    """Version 1: the heaviest slot first, each to the shard that has the fewest bytes (ties: the lower shard number)."""
    heap, out, cut = [(0, s) for s in range(shards)], [], set(split)
    for slot in sorted(range(slots), key=lambda k: (-sizes.get(k, (0, 0))[0], k)):
        b, n = sizes.get(slot, (0, 0))
        total, shard = heapq.heappop(heap)
        heapq.heappush(heap, (total + b, shard))
        out.append((1, slot, shard, b, n, slot in cut))
    return sorted(out)


def rebalanced(old: list[tuple], shards: int) -> list[tuple]:
    """The next version of a map for `shards` shards, moving as few slots as it can.

    Slots of shards that are gone move first, then slots of shards above the mean go to shards below it while a move
    narrows the gap. When a shard is added, slots move only into it. What is split stays split."""
    version = max(r[0] for r in old) + 1
    load, held, at = dict.fromkeys(range(shards), 0), {s: [] for s in range(shards)}, {}
    homeless = []
    for _, slot, shard, b, n, split in old:
        if shard in load:
            load[shard] += b
            held[shard].append((b, slot))
        else:
            homeless.append((b, slot))
        at[slot] = [shard, b, n, split]
    for b, slot in sorted(homeless, key=lambda x: (-x[0], x[1])):
        to = min(load, key=lambda s: (load[s], s))
        load[to] += b
        held[to].append((b, slot))
        at[slot][0] = to
    for s in held:
        held[s].sort()
    while True:
        high, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fits = [x for x in held[high] if 0 < x[0] < gap]
        if not fits:
            break
        b, slot = min(fits, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[high].remove((b, slot))
        held[low].append((b, slot))
        load[high] -= b
        load[low] += b
        at[slot][0] = low
    return sorted((version, slot, *held_) for slot, held_ in at.items())


def build_map(docs: DataFrame, shards: int, slots: int = SLOTS, **cols: str) -> list[tuple]:
    """Version 1 of the map for these records; the driver receives one row per slot, once more where slots are split."""
    rows = records(docs, **cols)
    sizes = slot_statistics(rows, [], slots)
    most = SPLIT_PART * sum(b for b, _ in sizes.values()) / shards
    split = sorted(s for s, (b, n) in sizes.items() if n > SPLIT_ROWS and b > most)
    return first_map(slot_statistics(rows, split, slots) if split else sizes, shards, slots, split)


def save_map(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Store one version of the map beside the others, which stay readable; writing a version again replaces it."""
    version = rows[0][0]
    spark.createDataFrame([r[1:] for r in rows], MAP_SCHEMA.split(", ", 1)[1]).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple]:
    """The stored map of one version, the latest by default."""
    stored = spark.read.parquet(path)
    version = version if version is not None else stored.agg(F.max("version")).first()[0]
    picked = stored.where(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes", "rows", "split")
    return sorted(tuple(r) for r in picked.collect())


def assign(docs: DataFrame, slot_map: list[tuple], slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every record by the map: id, size, text_crc32, shard, slot (place in the shard, gapless from 0), virtual_slot.

    A place is the rows of the shard's lower virtual slots, known from the map, plus the rank inside the virtual slot, so
    no task orders a whole shard, nor all rows of one id or all copies of one row. Repeated rows stay separate rows. A null text
    counts as empty; null ids are told apart by their texts. An empty table gives no rows. Other columns of the input are not
    read, so clashing names do no harm."""
    first, offsets = {}, []
    for version, slot, shard, _, n, _ in sorted(slot_map):
        offsets.append((version, slot, shard, first.get(shard, 0)))
        first[shard] = first.get(shard, 0) + n
    lookup = docs.sparkSession.createDataFrame(offsets, "map_version int, virtual_slot int, shard int, before long")
    split = [r[1] for r in slot_map if r[5]]
    rows = records(docs, id_col, text_col).withColumn("virtual_slot", virtual_slot(split, slots))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "record", "place"))
    placed = rows.withColumn("rank", rank).join(F.broadcast(lookup), "virtual_slot")
    return placed.select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), "virtual_slot", "map_version")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards whose sizes are near equal (law `bytes`).

    The map is stored in the shared folder as version 1 and edited into version 2, which has one more shard; both are read back.
    shard and slot follow version 1; next_shard is where version 2 puts the record, which is its shard or the new one."""
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    docs = records(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    save_map(spark, build_map(docs, 24), path)
    save_map(spark, rebalanced(load_map(spark, path), 25), path)
    moved = {slot: shard for _, slot, shard, *_ in load_map(spark, path, 2)}
    grown = spark.createDataFrame(sorted(moved.items()), "virtual_slot int, next_shard int")
    out = assign(docs, load_map(spark, path, 1)).join(F.broadcast(grown), "virtual_slot")  # SLOTS rows
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "next_shard")
