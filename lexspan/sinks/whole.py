"""Exports that are seen whole or not at all: a data source whose tasks write files aside, and whose commit names them in one manifest.

    spark.dataSource.register(WholeExport)
    df.write.format("whole_export").mode("append").save("hdfs://.../export")
    spark.read.format("whole_export").schema(df.schema).load("hdfs://.../export")

A file counts if the newest manifest names it. So a write that fails, or is retried by another executor, shows nothing of itself; readers
of the last manifest aren't disturbed, and an overwrite becomes visible at once. An abort deletes what its tasks have told of; what tasks wrote that were
lost or ended with the job is never seen, and ``swept`` deletes it. One JSON document a line.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FILES, MANIFESTS = "files", "manifests"


@dataclass
class Written(WriterCommitMessage):
    name: str
    n_rows: int


@dataclass
class File(InputPartition):
    name: str


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _newest(system: fs.FileSystem, at: str) -> dict:
    """The newest manifest; an export without any is empty."""
    there = [x for x in system.get_file_info(fs.FileSelector(f"{at}/{MANIFESTS}", allow_not_found=True)) if x.base_name.endswith(".json")]
    if not there:
        return {"files": [], "n_rows": 0}
    with system.open_input_stream(max(x.path for x in there)) as f:
        return json.loads(f.read())


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        system, at = _place(self.path)
        name, n = f"part-{uuid.uuid4().hex}.jsonl", 0
        system.create_dir(f"{at}/{FILES}", recursive=True)
        try:
            with system.open_output_stream(f"{at}/{FILES}/{name}") as f:
                for row in iterator:
                    f.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n").encode())
                    n += 1
        except BaseException:
            system.delete_file(f"{at}/{FILES}/{name}")
            raise
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _place(self.path)
        new = [m for m in messages if m is not None]
        old = {"files": [], "n_rows": 0} if self.overwrite else _newest(system, at)
        manifest = {"files": [*old["files"], *(m.name for m in new if m.n_rows)], "n_rows": old["n_rows"] + sum(m.n_rows for m in new)}
        system.create_dir(f"{at}/{MANIFESTS}", recursive=True)
        name = f"{at}/{MANIFESTS}/{time.time_ns():020d}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{name}.tmp") as f:
            f.write(json.dumps(manifest).encode())
        system.move(f"{name}.tmp", f"{name}.json")  # the moment at which the export is there

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _place(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{at}/{FILES}/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.names = options["path"], schema.names

    def partitions(self) -> list[File]:
        system, at = _place(self.path)
        return [File(x) for x in _newest(system, at)["files"]] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.name:
            return
        system, at = _place(self.path)
        with system.open_input_stream(f"{at}/{FILES}/{partition.name}") as f:
            for line in f.read().decode().split("\n"):
                if line:
                    row = json.loads(line)
                    yield tuple(row.get(c) for c in self.names)


def swept(path: str, older: float = 24 * 3600.0) -> int:
    """Deletes files that no manifest names and that are older than so many seconds, longer than any write takes; how many there were."""
    system, at = _place(path)
    named: set[str] = set()
    for x in system.get_file_info(fs.FileSelector(f"{at}/{MANIFESTS}", allow_not_found=True)):
        if x.base_name.endswith(".json"):
            with system.open_input_stream(x.path) as f:
                named.update(json.loads(f.read())["files"])
    files = system.get_file_info(fs.FileSelector(f"{at}/{FILES}", allow_not_found=True))
    gone = [x.path for x in files if x.base_name not in named and x.mtime_ns < time.time_ns() - older * 1e9]
    for x in gone:
        system.delete_file(x)
    return len(gone)


class WholeExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_export"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)
