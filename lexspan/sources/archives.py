"""Archives of documents as a data source: mail folders by byte ranges, and zip archives by ranges of entries.

    spark.dataSource.register(Archives)
    spark.read.format("archives").option("splitBytes", 64 << 20).load("hdfs://.../mail.mbox")

Each row is a file that ``ingest.ingest`` takes: (path, entry, filename, content), binary files in base 64, as there. A mail
folder is divided into ranges of bytes, of which each task reads the messages that begin within; a zip archive into ranges of entries of about as
many bytes. So one large archive is work for many tasks, and a lost task reads its range again.
"""

from __future__ import annotations

import base64
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, entry string, filename string, content string"
SPLIT_BYTES = 64 << 20
_MARK = b"\nFrom "
_BINARY = (".docx", ".doc", ".pdf", ".msg")


@dataclass
class Range(InputPartition):
    """Bytes of a mail folder, or entries of a zip archive, from ``start`` up to ``end``."""

    path: str
    start: int
    end: int
    entries: bool


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else fs.FileSystem.from_uri(f"/{path}")


class _Raw(io.RawIOBase):
    """An open file as zip archives are read: a place before its start is an OSError."""

    def __init__(self, f) -> None:  # noqa: ANN001
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.f.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        to = at + (0, self.f.tell(), self.f.size())[whence]
        if to < 0:
            raise OSError("before the start")
        return self.f.seek(to)

    def readinto(self, b) -> int:  # noqa: ANN001
        data = self.f.read(len(b))
        b[: len(data)] = data
        return len(data)


def _zip(f) -> zipfile.ZipFile:  # noqa: ANN001
    return zipfile.ZipFile(io.BufferedReader(_Raw(f), 1 << 16))


def _files(path: str) -> list[tuple[str, int]]:
    """The archives at a path, a file or a folder, with their sizes."""
    system, at = _place(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        system, _ = _place(self.path)
        out = []
        for path, size in _files(self.path):
            if not path.endswith(".zip"):
                out += [Range(path, a, min(a + self.size, size), False) for a in range(0, size, self.size)]
                continue
            with system.open_input_file(path) as f, _zip(f) as z:
                start = held = 0
                infos = z.infolist()
                for i, x in enumerate(infos):
                    held += x.file_size
                    if held >= self.size or i == len(infos) - 1:
                        out.append(Range(path, start, i + 1, True))
                        start, held = i + 1, 0
        return out or [Range("", 0, 0, False)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return iter(())
        system, _ = _place(self.path)
        return _entries(system, partition) if partition.entries else _messages(system, partition)


def _entries(system: fs.FileSystem, r: Range) -> Iterator[tuple]:
    with system.open_input_file(r.path) as f, _zip(f) as z:
        for x in z.infolist()[r.start : r.end]:
            if x.is_dir():
                continue
            data = z.read(x)
            yield r.path, x.filename, x.filename.rpartition("/")[2], base64.b64encode(data).decode() if x.filename.lower().endswith(_BINARY) else data.decode("utf-8", "replace")


def _messages(system: fs.FileSystem, r: Range, block: int = 1 << 20) -> Iterator[tuple]:
    """The messages whose first line begins in the range; the last one may end after it."""
    with system.open_input_file(r.path) as f:
        f.seek(max(r.start - 1, 0))
        at, held = max(r.start - 1, 0), b""  # ``held`` begins at the file's byte ``at``
        more = True
        if r.start == 0:
            at, held = -1, b"\n"  # a mark as any other
        begin: int | None = None  # where in ``held`` the message at hand begins
        seen = 0
        while True:
            found = held.find(_MARK, seen)
            if found < 0:
                if not more:
                    break
                new = f.read(block)
                more = bool(new)
                keep = begin if begin is not None else max(len(held) - len(_MARK), 0)
                at, held = at + keep, held[keep:] + new
                begin = 0 if begin is not None else None
                seen = max(0, len(held) - len(new) - len(_MARK))
                if begin is not None:
                    seen = max(seen, 1)
                continue
            if begin is not None:
                yield _message(r.path, at + begin + 1, held[begin + 1 : found + 1])
            if at + found + 1 >= r.end:
                return
            begin, seen = found, found + 1
        if begin is not None:
            yield _message(r.path, at + begin + 1, held[begin + 1 :])


def _message(path: str, at: int, raw: bytes) -> tuple:
    """A message without its first line, and with quoted marks as they were."""
    body = raw.partition(b"\n")[2].replace(b"\n>From ", b"\nFrom ")
    return path, str(at), f"{at}.eml", body.decode("utf-8", "replace").rstrip("\n") + "\n"


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)
