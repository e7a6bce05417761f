"""Folders as a data source, in batch and as a stream: one row a file, whatever its name.

    spark.dataSource.register(FolderSource)
    spark.read.format("folder").option("path", "/photos").load()
    spark.readStream.format("folder").option("path", "/photos").load()

Tasks walk the tree themselves: every task reads the names of the two upper levels and keeps, by a hash of the name, its share
of what lies there, with all that is below. Names come from the folder one by one and leave the task in pages of ``page``
rows, so a folder of any size is never a list in memory; nothing is listed on the driver. The folder must be
mounted on all machines.

The offset of the stream is a point in time: a batch has the files whose last change of any kind (content, name or place) lies
between two offsets. So a file that is moved in with an old modification time is seen, no names are remembered, and a file that
changes later is a row again. Offsets stay ``settle_ms`` behind the clock, as clocks differ and a folder may be written to
while it is read.

Links to folders are not followed. A folder that cannot be read is a row with its ``problem``.
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LISTING = "path string, length long, modified timestamp, problem string"
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("problem", pa.string())])
# Entries this many levels below the root are dealt to tasks.
_DEALT = 2


@dataclass
class Share(InputPartition):
    """Part ``number`` of ``count`` of the files that changed after ``start`` and up to ``end`` (nanoseconds)."""

    number: int
    count: int
    start: int = -1
    end: int | None = None


def _mine(below: str, share: Share) -> bool:
    return zlib.crc32(below.encode("utf-8", "surrogateescape")) % share.count == share.number


def walk(root: str, share: Share, recursive: bool = True) -> Iterator[tuple[str, int | None, int, str | None]]:
    """Path, length, time of modification (microseconds) and problem of the files of one share."""
    todo = [(root, 1)]
    while todo:
        folder, level = todo.pop()
        try:
            with os.scandir(folder) as entries:
                for entry in entries:
                    is_folder = entry.is_dir(follow_symlinks=False)
                    below = os.path.relpath(entry.path, root)
                    dealt = level == _DEALT or level < _DEALT and not is_folder
                    if dealt and not _mine(below, share):
                        continue
                    if is_folder:
                        if recursive:
                            todo.append((entry.path, level + 1))
                        continue
                    try:
                        if not entry.is_file():
                            continue
                        about = entry.stat()
                    except OSError:
                        continue  # gone since its name was read
                    if about.st_ctime_ns > share.start and (share.end is None or about.st_ctime_ns <= share.end):
                        yield entry.path, about.st_size, about.st_mtime_ns // 1000, None
        except OSError as failure:
            # One task tells of a folder that all of them read.
            if level > _DEALT or _mine(os.path.relpath(folder, root), share):
                yield folder, None, 0, failure.strerror or type(failure).__name__


def _pages(root: str, share: Share, recursive: bool, page: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for path, length, modified, problem in walk(root, share, recursive):
        # Names that are no text are shown with question marks.
        rows.append((path.encode("utf-8", "replace").decode(), length, modified, problem))
        if len(rows) == page:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class _Options:
    def __init__(self, options) -> None:
        path = options.get("path")
        if not path:
            raise ValueError("the folder source needs a path")
        plain = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
        self.root = plain.rstrip("/") or "/"
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.tasks = int(options.get("tasks", "8"))
        self.page = int(options.get("page", "10000"))
        self.settle = int(options.get("settle_ms", "1000")) * 1_000_000


class FolderReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = _Options(options)

    def partitions(self) -> list[Share]:
        return [Share(k, self.options.tasks) for k in range(self.options.tasks)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return _pages(self.options.root, partition, self.options.recursive, self.options.page)


class FolderStreamReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.options = _Options(options)

    def initialOffset(self) -> dict:
        return {"changed_ns": -1}

    def latestOffset(self) -> dict:
        return {"changed_ns": time.time_ns() - self.options.settle}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(k, self.options.tasks, start["changed_ns"], end["changed_ns"]) for k in range(self.options.tasks)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return _pages(self.options.root, partition, self.options.recursive, self.options.page)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStreamReader:
        return FolderStreamReader(self.options)
