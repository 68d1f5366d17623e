"""Whole files as rows, where a file that can't be read is a row too.

A folder is listed once and its files are dealt out by their sizes. Where the
paths are data, a manifest lists them: a folder of text files with one path a
line, whose part files are the planning unit: the driver lists the parts, never
the paths in them. Either way a task opens the files of its part one by one.
Paths may be of any file system that pyarrow knows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Paths in one part of a manifest.
MANIFEST_PATHS = 10_000
#: Bytes of files in one task, unless one file has more.
PART_BYTES = 128 << 20
#: Bytes of files that are handed on at once, unless one file has more.
BATCH_BYTES = 16 << 20

BLOB_SCHEMA = "path string, length bigint, content binary, error string"


def file_system(path: str):
    """(pyarrow file system, path on it) of a path or URI."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        if scheme == "file":
            return fs.LocalFileSystem(), "/" + rest.lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def plain_path(uri: Column) -> Column:
    """The path of a file column of Spark as it is written by users: without
    the scheme of local files, and without percent codes."""
    return F.url_decode(F.replace(F.regexp_replace(uri, r"^file:(//)?", ""), F.lit("+"), F.lit("%2B")))


class _Part(InputPartition):
    """Paths of files to open, or the part of a manifest that lists them."""

    def __init__(self, paths: list[str] | None = None, listed: str | None = None):
        self.paths, self.listed = paths, listed


class _BlobReader(DataSourceReader):
    def __init__(self, options):
        self.manifest, self.path, self.glob = options.get("manifest"), options.get("path"), options.get("glob", "*")

    def partitions(self) -> list[_Part]:
        from pyarrow import fs
        if self.manifest:
            system, path = file_system(self.manifest)
            found = system.get_file_info(fs.FileSelector(path))
            return [_Part(listed=x.path) for x in sorted(found, key=lambda x: x.path)
                    if x.is_file and not x.base_name.startswith(("_", "."))]
        parts: list[_Part] = []
        room, left = 0, 0
        for path, size in self._files():
            if size > room or not left:
                parts.append(_Part([]))
                room, left = PART_BYTES, MANIFEST_PATHS
            parts[-1].paths.append(path)
            room, left = room - size, left - 1
        return parts or [_Part([])]

    def _files(self) -> list[tuple[str, int]]:
        """(path, bytes) of what isn't a folder at or below the path or pattern."""
        import re
        from fnmatch import fnmatch

        from pyarrow import fs
        system, path = file_system(self.path)
        pattern = None
        if cut := re.search(r"[*?\[]", path):
            path, pattern = path[:cut.start()].rpartition("/")[0], path
        top = system.get_file_info(path)
        found = [top] if top.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        scheme = self.path.partition(":")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        return [(scheme + x.path, x.size or 0) for x in sorted(found, key=lambda x: x.path)
                if x.type != fs.FileType.Directory and fnmatch(x.base_name, self.glob) and (pattern is None or fnmatch(x.path, pattern))]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "length", "content", "error"])

        rows, held = [], 0
        listed = partition.paths
        if partition.listed:
            system, _ = file_system(self.manifest)
            with system.open_input_stream(partition.listed, compression=None) as part:
                listed = part.read().decode().split("\n")
        for path in filter(None, listed):
            try:
                system, name = file_system(path)
                with system.open_input_stream(name, compression=None) as f:
                    content = f.read()
                rows.append((path, len(content), content, None))
                held += len(content)
            except OSError as e:
                rows.append((path, None, None, type(e).__name__))
            if held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class BlobSource(DataSource):
    """Format ``blobs``: the files that the manifest of option ``manifest``
    lists, or those at ``path`` whose names match ``glob``."""

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return BLOB_SCHEMA

    def reader(self, schema) -> _BlobReader:
        return _BlobReader(self.options)


def write_manifest(paths: DataFrame, path: str, column: str = "path") -> str:
    """The paths of a frame as a manifest; returns its folder."""
    paths.select(column).write.option("maxRecordsPerFile", MANIFEST_PATHS).option("lineSep", "\n").text(path)
    return path


def read_listed_blobs(spark: SparkSession, manifest: str) -> DataFrame:
    """``(path, length, content, error)``: a row for every path of the manifest.

    A path that doesn't exist (any more) or can't be opened or read has NULL
    length and content, and the kind of error; all others have NULL there.
    Tasks read a part of the manifest each, in batches of bounded bytes.
    """
    spark.dataSource.register(BlobSource)
    return spark.read.format("blobs").option("manifest", manifest).load()


def read_blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The files at and below a folder, or of a pattern, as ``(path, length,
    content, error)``. Files are opened one by one: one that has vanished since
    they were listed, or can't be read, is reported and stops nothing."""
    spark.dataSource.register(BlobSource)
    r = spark.read.format("blobs").option("path", path)
    return (r.option("glob", glob) if glob else r).load()


def write_files(files: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Write a file for each row: ``content`` (BINARY) at ``path`` below
    ``root``. A repeated task writes the same files again. Returns their number."""
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        system, base = file_system(root)
        made, n = set(), 0
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                target = f"{base.rstrip('/')}/{name}"
                folder = os.path.dirname(target)
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target, compression=None) as f:
                    f.write(data.as_buffer() or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    return rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0
