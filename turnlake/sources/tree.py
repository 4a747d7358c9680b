"""Recording trees as a data source: spark.read.format("recording_tree") gives the lines of a tree's text files,
which the readers then parse.

A recording is a folder below the path (NAME or file_id=NAME, with files in it or in a folder below), its files
are text. Filters on file_id, name and modified are pushed: folders and files that they rule out are not opened.
Folders are dealt to tasks by bytes; as a stream, a batch is what was changed between two times, and files
are left to settle first. Folders are listed where pyarrow has a file system for them."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

FORMAT = "recording_tree"
SCHEMA = "file_id string, name string, modified long, line_no long, value string"
#: Bytes of files that one task reads, about.
TASK_BYTES = 64 << 20
#: Microseconds for which a changed file must have rested to be part of a stream's batch.
SETTLE_US = 2_000_000
_TESTS = {
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x),
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
}


@dataclass(frozen=True)
class Text:
    """A text file of a recording; modified in microseconds."""

    path: str
    file_id: str
    name: str
    modified: int
    size: int


class Part(InputPartition):
    """The files that one task reads."""

    def __init__(self, number: int):
        super().__init__(number)
        self.files: list[Text] = []


def listed(root: str) -> list[Text]:
    """All files of the tree but hidden ones, by path."""
    store, top = pyarrow.fs.FileSystem.from_uri(root if "://" in root else "file://" + root)
    out = []
    for f in store.get_file_info(pyarrow.fs.FileSelector(top, recursive=True)):
        steps = f.path[len(top.rstrip("/")) + 1 :].split("/")
        if f.type == pyarrow.fs.FileType.File and len(steps) > 1 and not any(s.startswith((".", "_")) for s in steps):
            out.append(Text(f.path, steps[0].removeprefix("file_id="), steps[-1], (f.mtime_ns or 0) // 1000, f.size or 0))
    return sorted(out, key=lambda t: t.path)


def dealt(files: list[Text], task_bytes: int = TASK_BYTES) -> list[Part]:
    """Files in order of path as parts of some task_bytes each."""
    parts, held = [Part(0)], 0
    for f in files:
        if held and held + f.size > task_bytes:
            parts.append(Part(len(parts)))
            held = 0
        parts[-1].files.append(f)
        held += f.size
    return parts


def lines(root: str, part: Part) -> Iterator[tuple]:
    store, _ = pyarrow.fs.FileSystem.from_uri(root if "://" in root else "file://" + root)
    for f in part.files:
        with store.open_input_stream(f.path) as stream:
            held, n = b"", 0
            while block := stream.read(1 << 20):
                *whole, held = (held + block).split(b"\n")
                for line in whole:
                    yield f.file_id, f.name, f.modified, n, line.decode("utf-8", "replace").removesuffix("\r")
                    n += 1
            if held:
                yield f.file_id, f.name, f.modified, n, held.decode("utf-8", "replace").removesuffix("\r")


class TreeReader(DataSourceReader):
    def __init__(self, root: str, task_bytes: int):
        self.root, self.task_bytes, self.kept = root, task_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - the interface's name
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("file_id",), ("name",), ("modified",)):
                self.kept.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        return dealt([t for t in listed(self.root) if all(_TESTS[kind](getattr(t, a), v) for kind, a, v in self.kept)], self.task_bytes)

    def read(self, partition: Part) -> Iterator[tuple]:
        return lines(self.root, partition)


class TreeStream(DataSourceStreamReader):
    def __init__(self, root: str, task_bytes: int, settle_us: int):
        self.root, self.task_bytes, self.settle_us = root, task_bytes, settle_us

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until_us": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until_us": time.time_ns() // 1000 - self.settle_us}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return dealt([t for t in listed(self.root) if start["until_us"] < t.modified <= end["until_us"]], self.task_bytes)

    def read(self, partition: Part) -> Iterator[tuple]:
        return lines(self.root, partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class RecordingTree(DataSource):
    """Options: path, task_bytes, settle_us."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))

    def streamReader(self, schema) -> TreeStream:  # noqa: N802
        return TreeStream(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)), int(self.options.get("settle_us", SETTLE_US)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters pushed."""
    spark.dataSource.register(RecordingTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
