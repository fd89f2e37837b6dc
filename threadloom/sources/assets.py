"""A source and sink of assets (templates, schemas, guides, forms) in a folder: A-07 to A-14, B-16 to B-18, L-08.

`spark.read.format("assets").load(folder)` gives a row per asset; `df.write.format("assets").save(folder)` writes rows of kind, name,
body. An asset lies in `folder`/`kind`/`name`; names without a suffix get that of their kind. Filters on kind and name are taken
over by the source, which then lists and opens nothing else; a filter on the body stays with Spark. A task takes FILES assets.

A write stages its files beside the assets; the commit moves them into place, an abort deletes them, so a job that fails changes
no asset. Of rows with one kind and name in a job one is kept: the one with the largest body in the order of bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .event_source import opened

SCHEMA = "kind string, name string, body string, bytes long"
#: The suffix of each kind.
SUFFIX = {"templates": ".json", "schemas": ".schema.json", "guides": ".md", "forms": ".json"}
FILES = 256


def file_name(kind: str, name: str) -> str:
    """The name with the suffix of its kind. Names that would leave their folder are an error."""
    if not name or "/" in name or name.startswith((".", "_")) or "/" in kind or not kind or kind.startswith((".", "_")):
        raise ValueError(f"no asset can be called {kind}/{name}")
    suffix = SUFFIX.get(kind, "")
    return name if name.endswith(suffix) else name + suffix


class Named(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.kinds, self.names, self.prefix = folder.rstrip("/"), None, None, ""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        meet = lambda old, new: set(new) if old is None else old & set(new)
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            values = [f.value] if isinstance(f, (EqualTo, EqualNullSafe)) else list(f.value) if isinstance(f, In) else None
            if column == ("kind",) and values is not None:
                self.kinds = meet(self.kinds, values)
            elif column == ("name",) and values is not None:
                self.names = meet(self.names, values)
            elif column == ("name",) and isinstance(f, StringStartsWith) and not self.prefix:
                self.prefix = f.value
            elif column in (("kind",), ("name",)) and isinstance(f, IsNotNull):
                pass  # they never are
            else:
                yield f

    def partitions(self) -> list[Named]:
        system, root = opened(self.folder)
        listed = lambda path, kind: [x for x in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if x.type == kind and not x.base_name.startswith((".", "_"))]
        kinds = self.kinds if self.kinds is not None else {x.base_name for x in listed(root, pafs.FileType.Directory)}
        found = []
        for kind in sorted(k for k in kinds if k and "/" not in k):
            if self.names is not None:  # no listing: the files are known by name
                names = [n for n in self.names if n and "/" not in n and not n.startswith((".", "_"))]
                found += [(kind, x.base_name) for x in system.get_file_info([f"{root}/{kind}/{n}" for n in sorted(names)]) if x.is_file]
            else:
                found += [(kind, x.base_name) for x in listed(f"{root}/{kind}", pafs.FileType.File)]
        found = sorted(x for x in found if x[1].startswith(self.prefix))
        return [Named(found[k : k + FILES]) for k in range(0, len(found), FILES)] or [Named([])]

    def read(self, partition: Named) -> Iterator[tuple]:
        system, root = opened(self.folder)
        for kind, name in partition.files:
            with system.open_input_stream(f"{root}/{kind}/{name}") as file:
                body = file.read()
            yield kind, name, body.decode("utf-8", "replace"), len(body)


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]
    folder: str


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex
        self.overwrite = overwrite

    def write(self, iterator: Iterator) -> Staged:
        system, root = opened(self.folder)
        own = f"{root}/_staged-{self.job}/{uuid.uuid4().hex}"
        done: dict[tuple[str, str], bytes] = {}
        for row in iterator:
            key, body = (row["kind"], file_name(row["kind"], row["name"])), (row["body"] or "").encode()
            if key in done and done[key] >= body[:64]:
                with system.open_input_stream(f"{own}/{key[0]}/{key[1]}") as file:
                    if file.read() >= body:
                        continue
            done[key] = body[:64]
            system.create_dir(f"{own}/{key[0]}", recursive=True)
            with system.open_output_stream(f"{own}/{key[0]}/{key[1]}") as file:
                file.write(body)
        return Staged(sorted(done), own)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = opened(self.folder)
        best: dict[tuple[str, str], str] = {}
        for m in filter(None, messages):
            for kind, name in m.files:
                path = f"{m.folder}/{kind}/{name}"
                if (kind, name) in best and self._body(system, best[kind, name]) >= self._body(system, path):
                    continue
                best[kind, name] = path
        if self.overwrite:
            for kind in {k for k, _ in best}:
                if system.get_file_info(f"{root}/{kind}").type == pafs.FileType.Directory:
                    for x in system.get_file_info(pafs.FileSelector(f"{root}/{kind}")):
                        if x.is_file and (kind, x.base_name) not in best:
                            system.delete_file(x.path)
        for (kind, name), path in sorted(best.items()):
            system.create_dir(f"{root}/{kind}", recursive=True)
            system.move(path, f"{root}/{kind}/{name}")
        self._clean()

    @staticmethod
    def _body(system: pafs.FileSystem, path: str) -> bytes:
        with system.open_input_stream(path) as file:
            return file.read()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, root = opened(self.folder)
        if system.get_file_info(f"{root}/_staged-{self.job}").type == pafs.FileType.Directory:
            system.delete_dir(f"{root}/_staged-{self.job}")


class Assets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark offer filters to it."""
    spark.dataSource.register(Assets)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
