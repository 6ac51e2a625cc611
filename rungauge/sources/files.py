"""Many small files: listed, read and written in tasks, so that no path goes through the driver.

Spark's own file scans list in the driver and skip empty files.  Here the driver
sees the folders directly below the root only; a task lists each of them, and the
found files are read in tasks of their own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = "root string, path string, size long, link boolean"
FILES = "root string, path string, link boolean, content binary"
BATCH_BYTES = 16 * 1024 * 1024  # content handed on at once


def file_system(address: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of an address and the path in it; an address without scheme is local."""
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    if "://" not in address:
        return fs.LocalFileSystem(), os.path.abspath(address)
    return fs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1))


def scheme_of(address: str) -> str:
    """What an address has before the path that its file system knows."""
    store, path = file_system(address)
    return "" if isinstance(store, fs.LocalFileSystem) else address[: len(address.rstrip("/")) - len(path.rstrip("/"))]


def _hidden(path: str, root: str) -> bool:
    return any(part.startswith((".", "_")) for part in path[len(root) :].split("/") if part)


def run_folders(root: str) -> list[str]:
    """What lies directly below a folder: all that the driver itself lists."""
    store, base = file_system(root)
    return [scheme_of(root) + i.path for i in store.get_file_info(fs.FileSelector(base)) if not _hidden(i.path, base)]


def list_files(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """``root`` (its folder as given), ``path``, ``size`` and ``link`` (it or its folder is a symbolic link) of all files in the folders.

    One task lists one folder, or a few where there are many.  Names that begin with
    a dot or an underscore are left out, as in Spark's scans.  A file given in place
    of a folder is listed itself; a folder that is not there is an error.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root in batch.column(0).to_pylist():
                store, base = file_system(root)
                local, prefix = isinstance(store, fs.LocalFileSystem), scheme_of(root)
                top = store.get_file_info(base)
                found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
                found = [i for i in found if i.type == fs.FileType.File and not _hidden(i.path, base)]
                links = [local and (os.path.islink(i.path) or os.path.islink(os.path.dirname(i.path))) for i in found]
                columns = [pa.array([root] * len(found), pa.string()), pa.array([prefix + i.path for i in found], pa.string())]
                columns += [pa.array([i.size for i in found], pa.int64()), pa.array(links, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["root", "path", "size", "link"])

    rows = spark.createDataFrame([(f,) for f in folders], "folder string")
    return rows.repartition(max(1, min(len(folders), 8 * spark.sparkContext.defaultParallelism))).mapInArrow(find, LISTED)


def read_files(listed: DataFrame) -> DataFrame:
    """The whole content of listed files; one that can not be read has none (null)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows: list[tuple]) -> pa.RecordBatch:
            root, path, link, content = zip(*rows)
            columns = [pa.array(root, pa.string()), pa.array(path, pa.string()), pa.array(link, pa.bool_()), pa.array(content, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["root", "path", "link", "content"])

        rows, size = [], 0
        for batch in batches:
            for root, path, link in zip(*[batch.column(c).to_pylist() for c in ("root", "path", "link")]):
                store, at = file_system(path)
                try:
                    with store.open_input_stream(at) as stream:
                        content = stream.read()
                except (FileNotFoundError, PermissionError):
                    content = None
                rows.append((root, path, link, content))
                size += len(content or b"")
                if size > BATCH_BYTES or len(rows) >= 4096:
                    yield given(rows)
                    rows, size = [], 0
        if rows:
            yield given(rows)

    return listed.repartition("path").mapInArrow(read, FILES)


def write_files(rows: DataFrame, root: str, path: str, text: str) -> int:
    """Writes each row's ``text`` to the file ``root/path``; returns how many.

    A task that is run again writes the same files again.  Paths are unique.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(root)
        n = 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{base}/{name}"
                store.create_dir(os.path.dirname(target), recursive=True)
                with store.open_output_stream(target) as stream:
                    stream.write((value or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    written = rows.select(F.col(path).cast("string"), F.col(text).cast("string")).mapInArrow(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
