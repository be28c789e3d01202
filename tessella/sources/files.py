"""Files that tasks read by ranges, and a sink that writes files from ordered parts.

``write_parts`` takes rows (file, part, size, content): a task writes the parts
of its files one after another as they arrive, so it holds one batch of parts,
however long a file is. Files stand in a folder of the attempt until the whole
job has succeeded, and are then moved to their names; a job that fails, a task
that runs twice and an attempt that is lost leave nothing behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessella.workers import prepare

#: Files moved at a time when a job has succeeded.
MOVERS = 32


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI or a local path, and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, path = rest.removeprefix("//").partition("/")
    store, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{root.rstrip('/')}/{path}"


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int


class _PartsWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.attempts = f"{folder.rstrip('/')}/_attempts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        store, attempts = store_of(self.attempts)
        folder = f"{attempts}/{TaskContext.get().taskAttemptId()}"
        out = now = None
        files = told = due = 0
        try:
            for batch in iterator:
                names, sizes = batch["file"].to_pylist(), batch["size"].to_pylist()
                for name, size, content in zip(names, sizes, batch["content"], strict=True):
                    if name != now:
                        if out is not None:
                            self._close(out, now, told, due)
                        path = f"{folder}/{name}"
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        out, now, told, due, files = store.open_output_stream(path), name, 0, size, files + 1
                    data = content.as_buffer()
                    out.write(data)
                    told += data.size
            if out is not None:
                self._close(out, now, told, due)
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            if files:
                store.delete_dir(folder)
            raise
        return _Written(folder, files)

    @staticmethod
    def _close(out, name: str, told: int, due: int | None) -> None:
        out.close()
        if due is not None and told != due:
            raise ValueError(f"{name} would have {told} bytes instead of {due}: parts of it are missing or too many")

    def commit(self, messages: list) -> None:
        """Each task's own listing is read, one task at a time, so the driver never holds all names."""
        store, root = store_of(self.folder)
        for message in messages:
            if message is None or not message.files:
                continue
            found = [f for f in store.get_file_info(fs.FileSelector(message.folder, recursive=True)) if f.type == fs.FileType.File]
            moves = [(f.path, f"{root.rstrip('/')}/{f.path[len(message.folder) :].lstrip('/')}") for f in found]
            for parent in {to.rpartition("/")[0] for _, to in moves}:
                store.create_dir(parent, recursive=True)
            with ThreadPoolExecutor(MOVERS) as pool:
                list(pool.map(lambda move: store.move(*move), moves))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, attempts = store_of(self.attempts)
        if store.get_file_info(attempts).type == fs.FileType.Directory:
            store.delete_dir(attempts)


class PartsSink(DataSource):
    """``df.write.format("file_parts").option("path", folder)``; ``write_parts`` puts the rows in order first."""

    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def schema(self) -> str:
        return "file string, part long, size long, content binary"

    def writer(self, schema, overwrite: bool) -> _PartsWriter:
        return _PartsWriter(self.options["path"])


def write_parts(parts: DataFrame, folder: str) -> None:
    """Write (file, part, size, content) to ``folder``/file, parts in order; ``size`` is the whole file's bytes, or null.

    A file of another size is an error and isn't written, nor is any other of
    the job. A file that is there already is written anew.
    """
    spark = parts.sparkSession
    prepare(spark)
    spark.dataSource.register(PartsSink)
    rows = parts.select("file", F.col("part").cast("long").alias("part"), F.col("size").cast("long").alias("size"), "content")
    rows = rows.repartition("file").sortWithinPartitions("file", "part")
    rows.write.format("file_parts").option("path", folder).mode("append").save()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime of all files with a byte under ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")
