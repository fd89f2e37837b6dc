"""The store of event log, session changes and call log in batches: each is one write job and one commit, laid out for lookups.

A batch is written beside the store and moved into it by one rename, so its events and its sessions are there together or not at
all; a batch whose number is there already changes nothing. Within a batch, rows lie by table and by shelf (a hash of the
conversation), sorted by conversation and time, with Bloom filters on the conversation and the session's user: a lookup of one
conversation opens one shelf of each batch and skips the row groups without it. A conversation that fills its shelf is split over
several files, not gathered in one task.

Rename is atomic on HDFS and local disks. On an object store it is not: there, give each batch a path of its own and let a table
of your catalog name those that are whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .log_store import CALLS, CHANGES, EVENTS

#: Folders by conversation in each table of a batch. A store keeps the number that it began with.
SHELVES = 64
TABLES = {"events": EVENTS, "changes": CHANGES, "calls": CALLS}


def _columns(schema: str) -> dict[str, str]:
    return dict(c.split() for c in schema.split(", "))


ALL = {name: kind for schema in TABLES.values() for name, kind in _columns(schema).items()}


def shelf_of(conv_id: Column, shelves: int = SHELVES) -> Column:
    """The shelf of a conversation; rows without one lie on shelf 0."""
    return F.coalesce(F.pmod(F.xxhash64(conv_id.cast("long")), F.lit(shelves)), F.lit(0)).cast("int")


def commit(spark: SparkSession, path: str, batch: str | int, shelves: int = SHELVES, **tables: DataFrame) -> bool:
    """B-01, B-04, B-09: add the rows of `events`, `changes`, `calls` as one batch; whether it is this call that added it.

    False, and nothing changes, where the batch is there already: a batch that runs again may come with other times or in another
    order. A job that fails leaves nothing behind that a reader sees. An empty batch is a batch. Columns are cast to those of the
    store, which are null where a table lacks them; others are left out."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = files.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    goal = files.Path(f"{path}/batch={batch}")
    if system.exists(goal):
        return False
    rows = None
    for name, table in tables.items():
        own = _columns(TABLES[name])
        part = table.select(*[(F.col(c) if c in own and c in table.columns else F.lit(None)).cast(t).alias(c) for c, t in ALL.items()], F.lit(name).alias("table"))
        rows = part if rows is None else rows.unionByName(part)
    staged = f"{path}/_staging-{uuid.uuid4().hex}"
    laid = rows.withColumn("shelf", shelf_of(F.col("conv_id"), shelves)).hint("rebalance", "table", "shelf")
    writer = laid.sortWithinPartitions("table", "shelf", "conv_id", F.coalesce("created_at", "at"), "id").write.partitionBy("table", "shelf")
    for c in ("conv_id", "user_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    try:
        writer.parquet(staged)
        moved = system.rename(files.Path(staged), goal)
        # Where another writer was faster, some file systems put the folder into that batch instead of refusing.
        inside = files.Path(f"{path}/batch={batch}/{staged.rsplit('/', 1)[1]}")
        return bool(moved) and not (system.exists(inside) and system.delete(inside, True))
    finally:
        if system.exists(files.Path(staged)):
            system.delete(files.Path(staged), True)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{c}` {t}" for c, t in (ALL | {"batch": "string", "table": "string", "shelf": "int"}).items())
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of the store, all batches; only its folders are opened."""
    return _whole(spark, path).where(F.col("table") == name).select(*_columns(TABLES[name]), "batch", "shelf")


def lookup(spark: SparkSession, path: str, name: str, conv_ids: list[int], shelves: int = SHELVES) -> DataFrame:
    """The rows of some conversations: the index of the log, in effect. Opens their shelves only."""
    if not conv_ids:
        return table(spark, path, name).where(F.lit(False)).drop("shelf")
    there = spark.createDataFrame([(c,) for c in conv_ids], "c long").select(shelf_of(F.col("c"), shelves)).distinct().collect()
    return table(spark, path, name).where(F.col("shelf").isin([r[0] for r in there]) & F.col("conv_id").isin(list(conv_ids))).drop("shelf")
