"""Files of several schema versions read as one table: B-11 (a column was added), B-12 (a name was changed).

Nothing is rewritten. A version is a number in the folder's name; what happened between versions is a list of steps, and files of
a version get the steps that came after it. Each version is its own scan with its own columns, so filters and column pruning reach
the files through the renamed columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Add:
    """A column that was added; older rows have the default. A column that is there already is left."""

    name: str
    kind: str
    default: Any = None

    def on(self, df: DataFrame) -> DataFrame:
        return df if self.name in df.columns else df.withColumn(self.name, F.lit(self.default).cast(self.kind))


@dataclass(frozen=True)
class Rename:
    """A column that got another name. Where the new one is there already (a half-migrated file), it wins, the old one fills it."""

    old: str
    new: str

    def on(self, df: DataFrame) -> DataFrame:
        if self.old not in df.columns:
            return df
        return df.withColumn(self.new, F.coalesce(self.new, self.old)).drop(self.old) if self.new in df.columns else df.withColumnRenamed(self.old, self.new)


@dataclass(frozen=True)
class Retype:
    """A column that got another type."""

    name: str
    kind: str

    def on(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, F.col(self.name).cast(self.kind))


Step = Add | Rename | Retype

# How the session table came to its columns.
SESSION_STEPS: tuple[tuple[Step, ...], ...] = (
    (Rename("form_code", "context_key"), Retype("user_id", "string")),  # 1 to 2
    (Add("summary", "string", ""), Add("current_config", "string")),  # 2 to 3
)


def upgraded(df: DataFrame, version: int, steps: Sequence[Sequence[Step]]) -> DataFrame:
    """Rows of a version (from 1) with the columns of the last one. A version that the steps do not reach is an error."""
    if not 1 <= version <= len(steps) + 1:
        raise ValueError(f"unknown schema version {version}")
    return reduce(lambda d, step: step.on(d), [s for group in steps[version - 1 :] for s in group], df)


def read(spark: SparkSession, path: str, steps: Sequence[Sequence[Step]], columns: Sequence[str]) -> DataFrame:
    """The files under `path`/version=N, whatever versions are there, as one table of `columns` and the version they came in."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = files.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = sorted((s.getPath().getName(), str(s.getPath())) for s in system.listStatus(files.Path(path)) if s.getPath().getName().startswith("version="))
    if not folders:
        raise ValueError(f"no versions under {path}")
    parts = []
    for name, folder in folders:
        version = int(name.split("=")[1])
        parts.append(upgraded(spark.read.option("mergeSchema", "true").parquet(folder), version, steps).select(*columns, F.lit(version).alias("version")))
    return reduce(DataFrame.unionByName, parts)
