"""Text tables as gzip files that several tasks can read.

A file is a sequence of gzip members, each the compressed form of whole lines,
so any gzip reader gets the lines. In the folder ``_index`` lies an index with a row per member
(offset, compressed and plain size, lines). A file ends at ``file_bytes`` and is
read in stretches of ``split_bytes``: a task picks the members that begin in its
stretch and decompresses no others.

Files appear under their names only when the job commits: tasks write into a
folder of their own, a repeated task into another, and the commit moves what the
tasks that counted have written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corvid.sources.blobs import file_system

MEMBER_BYTES = 1 << 20
FILE_BYTES = 128 << 20
SPLIT_BYTES = 16 << 20


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.member_bytes, self.file_bytes = int(options.get("member_bytes", MEMBER_BYTES)), int(options.get("file_bytes", FILE_BYTES))
        self.level = int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        import gzip
        import uuid

        from pyspark import TaskContext
        task, mine = TaskContext.get(), uuid.uuid4().hex
        system, base = file_system(self.path)
        folder = f"{base}/_writing/{mine}"
        system.create_dir(folder, recursive=True)
        names, index, out = [], [], None

        def finish() -> None:
            nonlocal out, index
            if out is not None:
                out.close()
                with system.open_output_stream(f"{folder}/{names[-1]}.json") as f:
                    f.write("".join(json.dumps(x) + "\n" for x in index).encode())
            out, index = None, []

        def add(lines: list[bytes]) -> None:
            nonlocal out
            if out is None:
                names.append(f"part-{task.partitionId():06d}-{len(names):05d}-{mine[:8]}.gz")
                out = system.open_output_stream(f"{folder}/{names[-1]}", compression=None)
            plain = b"".join(lines)
            member = gzip.compress(plain, self.level, mtime=0)
            at = sum(index[-1][:2]) if index else 0
            out.write(member)
            index.append((at, len(member), len(plain), plain.count(b"\n")))
            if at + len(member) >= self.file_bytes:
                finish()

        lines, size = [], 0
        for batch in iterator:
            for value in batch.column(0):
                lines.append(bytes(value.as_buffer() or b"") + b"\n")
                size += len(lines[-1])
                if size >= self.member_bytes:
                    add(lines)
                    lines, size = [], 0
        if lines:
            add(lines)
        finish()
        return _Written(folder, names)

    def commit(self, messages: list) -> None:
        system, base = file_system(self.path)
        system.create_dir(f"{base}/_index", recursive=True)
        for m in filter(None, messages):
            for name in m.names:
                # the index first: a file in sight always has one
                system.move(f"{m.folder}/{name}.json", f"{base}/_index/{name}.json")
                system.move(f"{m.folder}/{name}", f"{base}/{name}")
        system.delete_dir(f"{base}/_writing")
        with system.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        system, base = file_system(self.path)
        system.delete_dir(f"{base}/_writing")


class _Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"].rstrip("/"), int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[_Stretch]:
        from pyarrow import fs
        system, base = file_system(self.path)
        files = [x for x in system.get_file_info(fs.FileSelector(base)) if x.is_file and x.base_name.endswith(".gz")]
        return [_Stretch(x.path, at, at + self.split) for x in sorted(files, key=lambda x: x.path) for at in range(0, x.size, self.split)]

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        import gzip
        system, _ = file_system(self.path)
        folder, _, name = partition.path.rpartition("/")
        with system.open_input_stream(f"{folder}/_index/{name}.json") as f:
            members = [json.loads(line) for line in f.read().splitlines()]
        with system.open_input_file(partition.path) as f:
            for number, (at, packed, plain, lines) in enumerate(members):
                if partition.start <= at < partition.end:
                    data = gzip.decompress(f.read_at(packed, at))
                    values = data[:-1].split(b"\n")
                    if len(data) != plain or len(values) != lines:
                        raise OSError(f"{partition.path}: member {number} has {len(data)} bytes in {len(values)} lines, not {plain} in {lines}")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values, pa.string()), pa.array([name] * lines), pa.array([number] * lines, pa.int32()),
                         pa.array(range(lines), pa.int32())], names=["value", "file", "member", "line_no"])


class GzipMembers(DataSource):
    """Format ``gzip_members``; options ``member_bytes``, ``file_bytes``, ``level`` and ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "gzip_members"

    def schema(self) -> str:
        return "value string, file string, member int, line_no int"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def write_gzip(lines: DataFrame, path: str, value: str = "value", **options: int) -> None:
    """One text column as lines; a newline inside a value starts another
    line, a null is an empty one. ``path`` must be new."""
    lines.sparkSession.dataSource.register(GzipMembers)
    rows = lines.select(F.coalesce(F.col(value), F.lit("")).alias("value"))
    rows.write.format("gzip_members").options(**options).mode("append").save(path)


def read_gzip(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """``(value, file, member, line_no)`` of a folder that ``write_gzip`` wrote."""
    spark.dataSource.register(GzipMembers)
    return spark.read.format("gzip_members").options(**options).load(path)


def member_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, packed, plain, lines) of every member, from the indexes."""
    rows = spark.read.text(f"{path.rstrip('/')}/_index").select(
        F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("file"),
        F.from_json("value", "array<bigint>").alias("x"))
    return rows.select("file", *[F.col("x")[i].alias(n) for i, n in enumerate(("at", "packed", "plain", "lines"))])
