"""Folders of files as Spark sources and sinks: uploads of any size, empty ones included, and files named by a column.

Registered by ``register``. Paths may be local or URIs that Arrow's file systems know. Contents are read and written by the tasks. ``upload_rows``
lists in the tasks, too; of the source ``uploads``, which streams need, the driver lists names, lengths and times, as Spark's own file sources do.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of the files that one task reads, and what a file costs besides its bytes.
TASK_BYTES, FILE_COST = 32 << 20, 1 << 16
#: Rows of a record batch, and bytes of its contents.
ROWS, BATCH_BYTES = 10_000, 8 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), path


def listed(path: str, glob: str) -> list[tuple[int, str, int]]:
    """(time in ns, file, length) of all files below path whose name fits glob, hidden ones and the writers' unfinished ones left out."""
    fs, root = opened(path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, glob) and f.base_name[0] not in "._")


def below(fs: pafs.FileSystem, folder: str, glob: str, recursive: bool) -> Iterator[tuple[str, int | None]]:
    """(path, length) of the files in a folder that ``listed`` takes; without recursive its folders, too, with no length."""
    for f in fs.get_file_info(pafs.FileSelector(folder, recursive=recursive, allow_not_found=True)):
        if f.type == pafs.FileType.Directory and not recursive:
            yield f.path, None
        elif f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, glob) and f.base_name[0] not in "._":
            yield f.path, f.size or 0


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def planned(files: list[tuple[str, int]], limit: int) -> list[Files]:
    """Files in order, dealt to tasks of about TASK_BYTES; a file over the limit is not read and costs no bytes."""
    tasks, room = [], 0
    for name, length in files:
        cost = FILE_COST + (length if length <= limit else 0)
        if not tasks or cost > room:
            tasks.append([])
            room = TASK_BYTES
        tasks[-1].append((name, length))
        room -= cost
    return [Files(t) for t in tasks]


class Uploads(DataSource):
    """file, length, outcome (ok, empty, too_large) and the content of good files. Options: path, glob (*), max_bytes (20 MiB)."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return "file string, length long, outcome string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return UploadReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return UploadStream(self.options)


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.path, self.glob, self.limit = options["path"], options.get("glob", "*"), int(options.get("max_bytes", 20 << 20))

    def read(self, partition: Files | None) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for name, length in partition.files if partition else ():  # Spark reads a folder without files as one partition, None
            if length > self.limit or length == 0:
                yield name, length, "too_large" if length else "empty", None
                continue
            with fs.open_input_stream(name, compression=None) as f:
                content = f.read(min(length, self.limit) + 1)
                if len(content) > length:  # the file has grown since it was listed
                    content += f.read(self.limit + 1 - len(content))
            good = 0 < len(content) <= self.limit  # the file may have grown or been cut since it was listed
            yield name, len(content) if good else length, "ok" if good else "too_large" if content else "empty", content if good else None


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of ROWS rows or BATCH_BYTES of content, the last column, at most (one longer row stays whole)."""
    out, held = [], 0
    for row in rows:
        size = len(row[-1]) if isinstance(row[-1], bytes) else 0
        if out and (len(out) >= ROWS or held + size > BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, held = [], 0
        out.append(row)
        held += size
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _listing(path: str, glob: str, first: bool):
    """first: the files and folders in path itself; then the files as they are, and all files below each folder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None]]:
        fs, root = opened(path)
        for b in batches:
            for name, length in zip(b.column("file").to_pylist(), b.column("length").to_pylist(), strict=True):
                if length is not None:
                    yield name, length
                else:
                    yield from below(fs, root if first else name, glob, not first)

    return lambda batches: _batched(rows(batches), pa.schema({"file": pa.string(), "length": pa.int64()}))


def upload_rows(spark: SparkSession, path: str, max_bytes: int, glob: str = "*") -> DataFrame:
    """The rows of ``uploads``, listed and read by tasks: one lists the folder itself, each folder in it is listed by one of many, and the files that
    they find are dealt to tasks that read them. The driver holds no names."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    names = spark.range(0, 1, 1, 1).select(F.lit(path).alias("file"), F.lit(None).cast("long").alias("length"))
    for first in (True, False):
        names = names.mapInArrow(_listing(path, glob, first), "file string, length long").repartition(tasks, "file")
    reading = _Reading({"path": path, "max_bytes": max_bytes})
    schema = pa.schema({"file": pa.string(), "length": pa.int64(), "outcome": pa.string(), "content": pa.binary()})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((row for b in batches for row in reading.read(Files(list(zip(b.column("file").to_pylist(), b.column("length").to_pylist(), strict=True))))), schema)

    return names.mapInArrow(read, "file string, length long, outcome string, content binary")


class UploadReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return planned([(name, length) for _, name, length in listed(self.path, self.glob)], self.limit)


class UploadStream(_Reading, DataSourceStreamReader):
    """Each file once, in the order of its last change; of a batch, the files changed after the offset before it and up to its own.

    Files must be moved or closed into the folder: one that changes after its batch counts as a new upload.
    """

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": max((t for t, _, _ in listed(self.path, self.glob)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return planned([(name, length) for t, name, length in listed(self.path, self.glob) if start["changed"] < t <= end["changed"]], self.limit)


class NamedFiles(DataSource):
    """A sink: rows (file, content) are written to path/file, the rows of one file after each other, each as it is. Option: path.

    Rows of a file must lie together in one partition, in their order; a null content writes nothing, but the file is made. A task writes to
    hidden files of its own and moves them at its end, so a repeated task replaces what a lost one left.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NamedFileWriter(self.options["path"])


class NamedFileWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = opened(self.path)
        made, folders, now, out = [], set(), None, None
        try:
            for batch in iterator:
                for name, content in runs(batch):
                    if out is None or name != now:
                        if out is not None:
                            out.close()
                        folder, base = posixpath.split(posixpath.join(root, name))
                        if ".." in name.split("/") or not base:
                            raise ValueError(f"not a file name below the folder: {name!r}")
                        if folder not in folders:
                            fs.create_dir(folder, recursive=True)
                            folders.add(folder)
                        made.append((posixpath.join(folder, f".{base}.{uuid.uuid4().hex}"), posixpath.join(folder, base)))
                        now, out = name, fs.open_output_stream(made[-1][0], compression=None)
                    if len(content):
                        out.write(content)
        finally:
            if out is not None:
                out.close()
        for part, target in made:
            fs.move(part, target)
        return WriterCommitMessage()


def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, memoryview]]:
    """Each run of rows of one file with their contents after each other, which an Arrow column holds as one piece of memory."""
    if not batch.num_rows:
        return
    found = pc.run_end_encode(batch.column("file"))
    content = pc.fill_null(batch.column("content").cast(pa.large_binary()), b"")
    _, offsets, data = content.buffers()
    at = np.frombuffer(offsets, np.int64)[content.offset :]
    held, begin = memoryview(data or b""), 0
    for name, end in zip(found.values.to_pylist(), found.run_ends.to_pylist(), strict=True):
        yield name, held[at[begin] : at[end]]
        begin = end


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Uploads)
    spark.dataSource.register(NamedFiles)
