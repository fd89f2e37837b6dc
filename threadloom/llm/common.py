"""Shared helpers: reliable checkpoints, connected components, block sizes."""

from __future__ import annotations

import ctypes
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are runs of anything but ASCII white space (a SQL string literal needs doubled backslashes).
WORD = r"[^\x20\x09-\x0D]+"
WORD_SQL = WORD.replace("\\", "\\\\")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: spark.checkpoint.dir, or one of our own where it is unset and driver and
    executors are one process (tests). On a cluster without the setting there is no such folder, which is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor share")
        found = tempfile.mkdtemp(prefix="threadloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs a re-read and not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key with at least one in so many rows is hot; there are at most so many such keys.
HOT_KEYS = 1000


def look_up(rows: DataFrame, found: DataFrame, key: str, count: str) -> DataFrame:
    """`rows` with the other columns of `found` (one row per key; null where a row has none), whatever share of them one key holds.

    count: the column of `found` that says how many of `rows` have the key; it goes. Keys of at least a HOT_KEYS-th of all rows,
    of which there are HOT_KEYS at most, are broadcast; their rows then meet the other join under keys of their own (a hash of the
    row), so no task gets more of one key than that share. `found` is read three times and should be materialized."""
    values = [c for c in found.columns if c not in (key, count)]
    total = found.agg(F.sum(count)).first()[0] or 0
    hot = found.where(F.col(count) >= max(2, total / HOT_KEYS)).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    own = F.when(F.col("_hot_key").isNull(), F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("r"))).otherwise(F.struct(F.col(key).alias("k"), F.xxhash64(*rows.columns).bitwiseOR(F.lit(1)).alias("r")))
    rest = found.where(F.col(count) < max(2, total / HOT_KEYS)).select(F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("r")).alias("_own"), F.struct(*values).alias("_rest"))
    joined = marked.withColumn("_own", own).join(rest, "_own", "left")
    picked = F.coalesce("_hot", "_rest")
    return joined.select(*rows.columns, *[picked[c].alias(c) for c in values])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever kind of file system it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bound_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Hold the Arrow batches in which whole texts go to Python to a size that does not depend on how long the texts are.

    These are settings of the session, and they stay: a frame that is returned lazily is only planned when its reader asks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, beside the next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def beside(edges: DataFrame, key: str, least: DataFrame, how: str) -> DataFrame:
    """`edges` with the `top` that `least` (hi, top: one row per node) has for the node in `key`.

    Both sides are read from what is stored, so each is dealt by an exchange of its own: of a node with very many edges, Spark's
    skew join then splits the edges over tasks. A side that came straight from its aggregate could not be split."""
    return edges.join(least.withColumnRenamed("hi", "_node"), F.col(key) == F.col("_node"), how).drop("_node")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component = the smallest node that links reach.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): each is one aggregate and one equi-join, nothing is
    gathered, and a hub's edges are split (see beside). Null ends and self links are ignored; an empty edge table gives no rows.
    Raises if max_rounds does not suffice (it needs O(log^2 n) rounds)."""
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
    e = materialize(e.distinct())
    seen = None
    least = lambda e: materialize(e.groupBy("hi").agg(F.min("lo").alias("top")))
    for _ in range(max_rounds):
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").bitwiseAND(0x7FFFFFFF))).first())
        if mark == seen or mark[0] == 0:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        seen = mark
        large = materialize(beside(e, "lo", least(e), "left").select("hi", F.coalesce("top", "lo").alias("lo")).distinct())
        both = F.array(F.struct("hi", F.col("top").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("top").alias("lo")))
        near = beside(large, "hi", least(large), "inner").select(F.explode(both).alias("s")).select("s.*")
        e = materialize(near.where("hi != lo").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def spans_at_space(data: bytes, size: int = 1 << 20):
    """Cut long UTF-8 text into slices of about `size` bytes that end at ASCII white space, so that no word is split."""
    if len(data) <= size:
        yield data
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        found = _SPACE.search(data, end) if end < len(data) else None
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
