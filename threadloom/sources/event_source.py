"""A streaming source of event-stream files: A-18, K-01, K-02. `spark.readStream.format("event_frames").load(folder)`.

Files of frames that servers append to, one stream each. An offset says how far each file was read, in bytes, and may lie within a
frame: a frame belongs to the batch in which it ends, and a reader looks back for its beginning. So every frame comes once, in
whatever pieces the file grew, also after a restart. seq is the place of the frame's end: it rises within a stream and is the
same in every run. The frame of kind `end` says in `frames` how many frames its stream has up to it, which proves that a
reader has all of them; what stands after it is not told.

Paths may be of any file system that pyarrow opens (local, file:, hdfs:, s3:). Register the source with `register(spark)`."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "stream string, seq long, event string, data string, frames long"
END = "end"
#: Bytes that one task reads of a file, and that a search for a frame's beginning reads at a time.
TASK_BYTES, LOOK_BYTES = 64 << 20, 1 << 16
GAP = b"\n\n"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def parsed(frame: bytes) -> tuple[str, str]:
    """(event, data): the last event line, all data lines one after the other, trimmed; an empty event is none."""
    event, data = "", []
    for line in frame.decode("utf-8", "replace").split("\n"):
        if line.startswith("event:"):
            event = line[6:].strip()
        elif line.startswith("data:"):
            data.append(line[5:].strip())
    return event, "".join(data)


class Slice(InputPartition):
    def __init__(self, path: str, stream: str, start: int, end: int):
        self.path, self.stream, self.start, self.end = path, stream, start, end


def beginning(file, start: int) -> int:
    """Where the frame begins that byte `start` lies in: after the last blank line that ends at or before it."""
    high = start
    while high > 0:
        low = max(0, high - LOOK_BYTES)
        file.seek(low)
        found = file.read(min(high + 1, start) - low).rfind(GAP)  # one byte more: the gap may lie over the cut
        if found >= 0:
            return low + found + len(GAP)
        high = low
    return 0


def frames(part: Slice) -> Iterator[tuple[int, bytes]]:
    """(place of its end, frame) of the frames that end in the slice, in order; never more than a piece and a frame in memory."""
    system, path = opened(part.path)
    with system.open_input_file(path) as file:
        at = beginning(file, part.start)
        file.seek(at)
        held, left = b"", part.end - at
        while left > 0 and (more := file.read(min(LOOK_BYTES, left))):
            left -= len(more)
            *whole, rest = (held + more).split(GAP) if GAP in held[-1:] + more else (held + more,)
            for frame in whole:
                at += len(frame) + len(GAP)
                yield at, frame
            held = rest


def rows(part: Slice) -> Iterator[tuple]:
    for end, frame in frames(part):
        if end <= part.start or not frame.strip():
            continue
        event, data = parsed(frame)
        if event:
            count = None
            if event == END:
                count = sum(1 for _, f in frames(Slice(part.path, part.stream, 0, end)) if parsed(f)[0])
            yield part.stream, end, event, data, count
            if event == END:
                return


class _Files:
    def __init__(self, folder: str):
        self.folder = folder

    def sizes(self) -> dict[str, int]:
        system, path = opened(self.folder)
        found = system.get_file_info(pafs.FileSelector(path, recursive=False, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.is_file and not f.base_name.startswith((".", "_"))}

    def slices(self, start: dict[str, int], end: dict[str, int]) -> list[Slice]:
        out = []
        for name in sorted(end):
            for low in range(start.get(name, 0), end[name], TASK_BYTES):
                out.append(Slice(f"{self.folder.rstrip('/')}/{name}", name, low, min(end[name], low + TASK_BYTES)))
        return out


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.files = _Files(folder)

    def partitions(self) -> list[Slice]:
        return self.files.slices({}, self.files.sizes()) or [Slice("", "", 0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return rows(partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are the sizes of the files, which only grow; the reader's `most` bounds what one batch takes of each."""

    def __init__(self, folder: str, most: int):
        self.files, self.most, self.told = _Files(folder), most, None

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        sizes = self.files.sizes()
        if self.most:
            before = self.told if self.told is not None else {}
            sizes = {k: min(v, before.get(k, 0) + self.most) for k, v in sizes.items()}
            self.told = sizes
        return {"files": json.dumps(sizes, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        first, last = json.loads(start["files"]), json.loads(end["files"])
        if self.told is None or any(last.get(k, 0) > v for k, v in self.told.items()):
            self.told = last  # after a restart, go on from what the checkpoint says
        return self.files.slices(first, last) or [Slice("", "", 0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return rows(partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


class EventFrames(DataSource):
    """Options: path, most_bytes (of each file in one micro-batch; all that is there by default)."""

    @classmethod
    def name(cls) -> str:
        return "event_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("most_bytes", "0")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventFrames)
