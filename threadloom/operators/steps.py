"""Steps over one table that can be stopped anywhere and go on: L-02, K-19, N-07 to N-14.

A step is a function from DataFrame to DataFrame; it may give a row a `question`. A row with a question leaves the pipeline there
and waits for its answer; all others go on. Each step is one write that is moved into place by one rename, so a run that dies is
repeated from the last step that was finished, and gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

Step = tuple[str, Callable[[DataFrame], DataFrame]]


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str, steps: Sequence[Step]) -> int:
    """How many steps of a run are there whole."""
    hadoop, system = _files(spark, path)
    return next((k for k, (name, _) in enumerate(steps) if not system.exists(hadoop.Path(f"{path}/{k:02d}-{name}"))), len(steps))


def _read(spark: SparkSession, path: str, k: int, steps: Sequence[Step], asked: bool) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{k:02d}-{steps[k][0]}").where(F.col("_asked") == asked).drop("_asked")
    return rows if asked else rows.drop("question")


def run(rows: DataFrame, steps: Sequence[Step], path: str) -> DataFrame:
    """The rows that came through all steps. Steps that are finished under `path` are not run again.

    A step sees the rows as the one before wrote them. Steps before the last read again are kept until the caller removes `path`.
    An empty table gives no rows; without steps the rows come back as they are."""
    spark = rows.sparkSession
    hadoop, system = _files(spark, path)
    for k in range(finished(spark, path, steps), len(steps)):
        name, step = steps[k]
        made = step(_read(spark, path, k - 1, steps, False) if k else rows)
        question = F.nullif(F.col("question"), F.lit("")) if "question" in made.columns else F.lit(None).cast("string")
        made = made.withColumn("question", question).withColumn("_asked", question.isNotNull())
        staged = f"{path}/_staging-{uuid.uuid4().hex}"
        try:
            made.write.parquet(staged)
            system.rename(hadoop.Path(staged), hadoop.Path(f"{path}/{k:02d}-{name}"))
        finally:
            system.delete(hadoop.Path(staged), True)
    return _read(spark, path, len(steps) - 1, steps, False) if steps else rows


def asked(spark: SparkSession, path: str, steps: Sequence[Step], columns: Sequence[str]) -> DataFrame:
    """The rows that wait for an answer: `columns`, the question, and the step that asked."""
    out = None
    for k in range(finished(spark, path, steps)):
        part = _read(spark, path, k, steps, True).select(*columns, "question", F.lit(steps[k][0]).alias("step"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no step was finished under {path}")
    return out


def answered(waiting: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """The rows to run again: those that wait, with what `answers` (key and columns to set) says; a null answer leaves what is there."""
    given = [c for c in answers.columns if c != key]
    both = waiting.drop("question", "step").join(answers.select(key, *[F.col(c).alias(f"_{c}") for c in given]), key)
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in waiting.columns if c not in ("question", "step")])
