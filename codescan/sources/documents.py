"""One file out of many tasks: ``df.write.format("document")``.

Tasks write the elements of a document as parts; only when all have ended are the parts joined, with what stands
before, between and after the elements.  A failed or repeated task leaves no trace in the document.  Packed parts
are compressed; a document of them is plain text all the same, unless it is so large that its parts stay.
"""

from __future__ import annotations

import gzip
import time
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from codescan.session import shuffles_freed

COPY_BYTES = 1 << 20
JOIN_BYTES = 1 << 30
LEVEL = 1  # of compression: texts of findings shrink to a tenth, at some 100 MB a second
ABORT_TRIES = 10


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote: nothing if it had no rows."""

    number: int
    path: str | None
    size: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, head: str, separator: str, tail: str, join_bytes: int, packed: bool):
        self.path, self.join_bytes, self.packed = path, join_bytes, packed
        self.head, self.separator, self.tail = (t.encode() for t in (head, separator, tail))
        self.token = uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, the document's path in it and the folder of its parts."""
        filesystem, inner = fs.FileSystem.from_uri(self.path)
        return filesystem, inner, f"{inner}.parts-{self.token}"

    def prepare(self) -> None:
        """Make the folder of the parts, before any task runs: one that outlives a failed job cannot make it again."""
        filesystem, _, folder = self._place()
        filesystem.create_dir(folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        filesystem, _, folder = self._place()
        number, path, out, size = task.partitionId(), None, None, 0
        with ExitStack() as files:
            for batch in iterator:
                for value in batch.column(0):
                    text = value.as_py()
                    if text is None:
                        continue
                    if out is None:
                        path = f"{folder}/{number:08d}-{task.taskAttemptId()}{'.gz' * self.packed}"
                        out = files.enter_context(filesystem.open_output_stream(path, compression=None, buffer_size=COPY_BYTES))
                        if self.packed:
                            out = files.enter_context(gzip.GzipFile("", "wb", LEVEL, out, 0))
                        size += out.write(text.encode())
                    else:
                        size += out.write(self.separator + text.encode())
        return Part(number, path, size)

    def commit(self, messages: list[Part | None]) -> None:
        filesystem, inner, folder = self._place()
        parts = sorted((m for m in messages if m is not None and m.path), key=lambda m: m.number)
        between = [p for m in parts for p in (self.separator, m.path)][1:]
        pieces = [p for p in (self.head, *between, self.tail) if p]
        filesystem.create_dir(folder)
        if sum(m.size for m in parts) > self.join_bytes:
            self._as_folder(filesystem, inner, folder, pieces, self.packed)
            return
        whole = f"{folder}/whole"
        with filesystem.open_output_stream(whole) as out:
            for piece in pieces:
                if isinstance(piece, bytes):
                    out.write(piece)
                    continue
                with filesystem.open_input_stream(piece) as part:
                    while chunk := part.read(COPY_BYTES):
                        out.write(chunk)
        _clear(filesystem, inner)
        filesystem.move(whole, inner)
        filesystem.delete_dir(folder)

    @staticmethod
    def _as_folder(filesystem: fs.FileSystem, inner: str, folder: str, pieces: list, packed: bool) -> None:
        """Pieces of a document too large to be copied by one process, named in their order."""
        _clear(filesystem, inner)
        filesystem.create_dir(inner)
        for i, piece in enumerate(pieces):
            name = f"{inner}/part-{i:08d}{'.gz' * packed}"
            if isinstance(piece, bytes):
                with filesystem.open_output_stream(name, compression=None) as out:
                    out.write(gzip.compress(piece, LEVEL, mtime=0) if packed else piece)
            else:
                filesystem.move(piece, name)
        filesystem.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        filesystem, _, folder = self._place()
        for tries in range(ABORT_TRIES):
            if filesystem.get_file_info(folder).type != fs.FileType.Directory:
                return
            try:
                filesystem.delete_dir(folder)
            except OSError:  # a task that still runs has opened a part meanwhile
                if tries == ABORT_TRIES - 1:
                    raise
                time.sleep(0.1)


def _clear(filesystem: fs.FileSystem, path: str) -> None:
    """Remove the document that is to be replaced."""
    kind = filesystem.get_file_info(path).type
    if kind == fs.FileType.File:
        filesystem.delete_file(path)
    elif kind == fs.FileType.Directory:
        filesystem.delete_dir(path)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        get = self.options.get
        made = DocumentWriter(self.options["path"], get("head", ""), get("separator", "\n"), get("tail", "\n"),
                              int(get("joinbytes", JOIN_BYTES)), get("packed", "false") == "true")
        made.prepare()
        return made


def write_document(rows: DataFrame, path: str, head: str = "", separator: str = "\n", tail: str = "\n",
                   join_bytes: int = JOIN_BYTES, packed: bool = False) -> None:
    """One file at ``path`` of the texts in the only column of ``rows``, in the order ``rows`` are sorted in.

    Null texts are left out; without rows the file is head and tail.  An older document is replaced when all tasks
    have ended.  The last step copies the parts a megabyte at a time; a document beyond ``join_bytes`` is not copied
    by one process but stays a folder whose files, taken by name, are the document.  With ``packed`` the parts are
    compressed, and so are the files of such a folder (``.gz``, which Spark's readers and zcat take as they are).
    """
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSource)
    with shuffles_freed(spark):
        (rows.toDF("value").write.format("document").mode("overwrite").option("head", head).option("separator", separator)
         .option("tail", tail).option("joinBytes", join_bytes).option("packed", str(packed).lower()).save(path))
