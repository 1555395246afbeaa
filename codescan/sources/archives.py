"""Zip archives as a data source: ``spark.read.format("archives").load(path)``.

An archive is read in ranges of its bytes, as Spark reads any large file: a task takes the members that begin in
its range.  Nothing but the list of files reaches the driver, and one large archive is many tasks.
"""

from __future__ import annotations

import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
OPEN_COST = 1 << 20
TASKS = 2048
BATCH_BYTES = 8 << 20
SCHEMA = pa.schema([("archive", pa.string()), ("file", pa.string()), ("content", pa.string())])


def leaves_archive(name: str) -> bool:
    """Whether a member's path is absolute or climbs out of the archive, in either kind of slash."""
    name = name.replace("\\", "/")
    return name.startswith("/") or ".." in name.split("/") or ".." in posixpath.normpath(name).split("/")


@dataclass(frozen=True)
class Split(InputPartition):
    """Ranges (path, start, end) of archives that one task reads."""

    ranges: tuple[tuple[str, int, int], ...]


def pack(files: list[tuple[str, int]], size: int) -> list[Split]:
    """Ranges of at most ``size`` bytes, small archives together; opening one counts as a megabyte.

    Where that makes more than ``TASKS`` tasks of small ranges, a task takes more of them, up to ``SPLIT_BYTES``;
    neighbours in one archive become one range, so it is opened once.
    """
    opening = min(OPEN_COST, size)
    total = sum(length + max(1, -(-length // size)) * opening for _, length in files)
    share = max(size, min(SPLIT_BYTES, total // TASKS))
    splits, current, load = [], [], 0
    for path, length in files:
        for start in range(0, max(length, 1), size):
            end = min(start + size, length)
            cost = end - start + opening
            if current and load + cost > share:
                splits.append(Split(tuple(current)))
                current, load = [], 0
            if current and share > size and current[-1][0] == path:
                start = current.pop()[1]
            current.append((path, start, end))
            load += cost
    # Without files one task with nothing to read: Spark would call it without a split.
    return [*splits, Split(tuple(current))] if current or not splits else splits


def _text(archive: zipfile.ZipFile, member: zipfile.ZipInfo) -> str | None:
    try:
        return archive.read(member).decode("utf-8", errors="ignore")
    except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError):
        return None


def members(path: str, start: int, end: int) -> Iterator[tuple[str, str, str | None]]:
    """(archive, file, content) of the members that begin in a range; none of an unsafe archive or of what is no archive."""
    filesystem, inner = fs.FileSystem.from_uri(path)
    with filesystem.open_input_file(inner) as raw:
        try:
            archive = zipfile.ZipFile(raw)
        except (zipfile.BadZipFile, pa.ArrowInvalid):  # The latter for files too short to hold a directory.
            return
        with archive:
            listed = archive.infolist()
            if any(leaves_archive(m.filename) for m in listed):
                return
            for m in listed:
                if start <= m.header_offset < end and not m.is_dir():
                    yield path, m.filename, _text(archive, m)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Split]:
        filesystem, inner = fs.FileSystem.from_uri(self.path)
        found = filesystem.get_file_info(inner)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [found] if found.type == fs.FileType.File else filesystem.get_file_info(fs.FileSelector(inner, recursive=True))
        # Names below the folder keep the scheme of the path they were asked for.
        files = sorted((self.path + i.path[len(inner):], i.size) for i in listed
                       if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
        return pack(files, self.size)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for split in partition.ranges:
            for row in members(*split):
                rows.append(row)
                held += len(row[1]) + len(row[2] or "")
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "archive string, file string, content string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"].rstrip("/"), int(self.options.get("splitbytes", SPLIT_BYTES)))


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(archive, file, content) of the zip archives below a path, or of the one it names.

    Nothing is read of an archive with a member that leaves it, nor of a file that is no archive; a member that
    cannot be read has NULL content.  Names that begin with ``_`` or ``.`` are passed by.  A task holds the list
    of members of one archive and a few megabytes of texts, or one text.
    """
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").option("splitBytes", split_bytes).load(path)
