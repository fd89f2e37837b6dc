"""Stored intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and driver and executors are one process (tests), a folder of our own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor share")
        found = tempfile.mkdtemp(prefix="threadloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: what was made is read again, not made again, also after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
