"""Spark data source ``docx``: packages below a path, read by members and written with commit and abort.

``register(spark)``, then ``spark.read.format("docx").load(path)`` gives a row
for each part, and ``df.write.format("docx").save(path)`` writes packages
(doc_id, content).  Files are reached through the file system of their path
(file, hdfs, s3, gs), which executors share.
"""

from __future__ import annotations

import hashlib
import io
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from . import docx

SCHEMA = "doc_id string, path string, package_size long, part_name string, part_key string, data binary, error_code string, error_message string, kind string, bytes_read long"
#: The list of a folder's committed pieces, each with its number of packages and bytes; without one every package below the folder counts.
COMMITTED = "_committed.json"
#: Packages and bytes after which a task goes on in another piece, and packages that are read together at most.
MOST_FILES, PIECE_BYTES = 1 << 12, 16 << 20


class _Counted(io.RawIOBase):
    """A file that tells how many of its bytes were read; the archive's directory and the members asked for are all that is."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.total = file, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        return self.file.seek(at, whence)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        self.total += len(data)
        return len(data)


@dataclass
class _Files(InputPartition):
    """Packages by their paths and sizes, and whole committed pieces, which the task that reads them lists."""

    paths: list[tuple[str, int]]
    folders: list[str] = field(default_factory=list)


def _below(where: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
    return (f for f in where.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File and f.path.endswith(".docx"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.kinds = frozenset(x.strip() for x in options.get("kinds", "").split(",") if x.strip())
        self.bytes = int(options.get("partitionBytes", 64 << 20))
        self.most = int(options.get("mostBytes", docx.MOST_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Which kinds are wanted is decided here, before a member is read; other conditions are Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                wanted = frozenset([f.value])
            elif isinstance(f, In) and f.attribute == ("kind",):
                wanted = frozenset(f.value)
            else:
                yield f
                continue
            self.kinds = self.kinds & wanted if self.kinds else wanted
            if not self.kinds:
                self.kinds = frozenset(["none of them"])
            yield f  # rows of errors have no kind of their own: Spark decides about them

    def partitions(self) -> list[InputPartition]:
        """The packages in groups of about ``partitionBytes``; a path that is not there is a group of its own."""
        where, folder = fs.FileSystem.from_uri(self.path)
        top = where.get_file_info(folder)
        if top.type == fs.FileType.NotFound:
            return [_Files([(folder, -1)])]
        if top.type == fs.FileType.File:
            return [_Files([(folder, top.size)])]
        pieces = [(folder, None, None)]
        listed = where.get_file_info(f"{folder}/{COMMITTED}")
        if listed.type == fs.FileType.File:
            with where.open_input_file(listed.path) as file:
                pieces = [(f"{folder}/{x}", None, None) if isinstance(x, str) else (f"{folder}/{x[0]}", *x[1:]) for x in json.loads(file.read())]
        groups, held, files, size = [], _Files([]), 0, 0
        for below, n, length in pieces:
            whole = n is not None and n <= MOST_FILES and length <= self.bytes
            # the paths of a committed piece never get here: they are as many as the packages
            for path, few, more in [(None, n, length)] if whole else ((f.path, 1, f.size) for f in _below(where, below)):
                if files and (files + few > MOST_FILES or size + more > self.bytes):
                    groups.append(held)
                    held, files, size = _Files([]), 0, 0
                if path is None:
                    held.folders.append(below)
                else:
                    held.paths.append((path, more))
                files, size = files + few, size + more
        return [*groups, held]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path)
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split(" ")[1]] for x in SCHEMA.split(", ")]

        def rows() -> Iterator[tuple]:
            listed = ((f.path, f.size) for folder in partition.folders for f in _below(where, folder))
            for path, size in chain(partition.paths, listed):
                doc_id = hashlib.sha256(path.encode()).hexdigest()
                try:
                    with where.open_input_file(path) as file:
                        counted = _Counted(file)
                        for _, *part in docx.members(doc_id, counted, self.kinds, self.most):
                            yield doc_id, path, size, *part, counted.total
                except FileNotFoundError as x:
                    yield doc_id, path, None, None, None, None, "NOT_FOUND", str(x), None, 0
                except OSError as x:
                    yield doc_id, path, None, None, None, None, "IO_ERROR", str(x), None, 0

        yield from docx.together(rows(), names, types, 5)


@dataclass
class _Written(WriterCommitMessage):
    """The folder of an attempt, and its pieces with their numbers of packages and bytes."""

    folder: str
    pieces: list[tuple[str, int, int]]


class _Writer(DataSourceArrowWriter):
    """Every attempt of a task writes into a folder of its own, in pieces of a bounded size; committing names the pieces that count, and removes all others.

    The job's folder is made by the driver alone: once a failed job has removed
    it, a task that still runs has no place to write to.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, f"part-{uuid.uuid4().hex}"
        where, top = fs.FileSystem.from_uri(path)
        where.create_dir(f"{top}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from ..sinks.docx import file_name

        where, top = fs.FileSystem.from_uri(self.path)
        folder = f"{self.job}/{uuid.uuid4().hex}"
        pieces, files, size = [], 0, 0
        for batch in iterator:
            for doc_id, content in zip(batch.column("doc_id").cast(pa.string()), batch.column("content"), strict=True):
                doc_id, content = doc_id.as_py(), content.as_py()
                if doc_id is None or content is None:
                    raise ValueError("a package needs doc_id and content")
                if not files:
                    if not pieces:
                        where.create_dir(f"{top}/{folder}", recursive=False)
                    piece = f"{folder}/{len(pieces)}"
                    where.create_dir(f"{top}/{piece}", recursive=False)
                    pieces.append((piece, 0, 0))
                with where.open_output_stream(f"{top}/{piece}/{file_name(doc_id)}") as out:
                    out.write(content)
                files, size = files + 1, size + len(content)
                pieces[-1] = (piece, files, size)
                if files >= MOST_FILES or size >= PIECE_BYTES:
                    files, size = 0, 0
        return _Written(folder, pieces)

    def _listed(self, where: fs.FileSystem, top: str) -> list:
        info = where.get_file_info(f"{top}/{COMMITTED}")
        if info.type != fs.FileType.File:
            return []
        with where.open_input_file(info.path) as file:
            return json.loads(file.read())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, top = fs.FileSystem.from_uri(self.path)
        where.create_dir(top, recursive=True)
        counted = {m.folder for m in messages if m is not None}
        own = sorted(x for m in messages if m is not None for x in m.pieces)
        before = self._listed(where, top)
        with where.open_output_stream(f"{top}/.{self.job}") as out:
            out.write(json.dumps(own if self.overwrite else [*before, *own]).encode())
        where.move(f"{top}/.{self.job}", f"{top}/{COMMITTED}")
        # what does not count: attempts that were repeated, and after an overwrite whatever packages were there
        for f in where.get_file_info(fs.FileSelector(f"{top}/{self.job}", allow_not_found=True)):
            if f"{self.job}/{f.base_name}" not in counted:
                where.delete_dir(f.path)
        if not own:
            where.delete_dir(f"{top}/{self.job}")
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(top)):
                if f.type == fs.FileType.Directory and f.base_name.startswith("part-") and f.base_name != self.job:
                    where.delete_dir(f.path)
                elif f.type == fs.FileType.File and f.base_name.endswith(".docx"):
                    where.delete_file(f.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, top = fs.FileSystem.from_uri(self.path)
        last = None
        for pause in (0, *[0.1] * 50):  # tasks that are being ended may still put a file where one was just removed
            time.sleep(pause)
            try:
                if where.get_file_info(f"{top}/{self.job}").type != fs.FileType.Directory:
                    return
                where.delete_dir(f"{top}/{self.job}")
            except OSError as x:
                last = x
        if last:
            raise last


class DocxSource(DataSource):
    """Options: kinds (a list with commas: the kinds of parts that are read), partitionBytes, mostBytes.

    Reading, a path that is not there, a file that cannot be opened and a
    damaged member are rows with error_code; bytes_read is what of a package's
    file was read up to its row.  A filter on ``kind`` reaches the reader, so
    members of other kinds are never read.  Writing appends to the packages
    that are there or, with mode overwrite, takes their place; nothing counts
    before the job has committed, and a job that fails leaves nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not {"doc_id", "content"} <= set(schema.fieldNames()):
            raise ValueError("packages are rows of doc_id and content")
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach Python readers (``spark.sql.python.filterPushdown.enabled``)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocxSource)
