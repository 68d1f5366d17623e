"""Trace logs on disk. Records end with ``] },\\n`` and may contain raw
newlines, so the text source splits on that multi-character separator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.functions.trace_text import BLANKS, RECORD_END, render_record
from corvid.plans.ordering import small_join, stored

#: A log may be cut into many files: they share a ``file=<log>`` folder.
LOG_KEY_PATTERN = r"file=([^/]+)"
#: Records of a written piece, unless the number of pieces is given.
PIECE_RECORDS = 1_000_000


def log_of(path: Column) -> Column:
    """The ``file=<log>`` folder of a path, else the path itself."""
    return F.when(path.rlike(LOG_KEY_PATTERN), F.regexp_extract(path, LOG_KEY_PATTERN, 1)).otherwise(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records ``(file, log, block_start, mid, value)`` without their
    terminator, in one pass. ``mid`` grows by one a record within a file split,
    so ``(file, block_start, mid)`` is the order of a log."""
    df = spark.read.option("lineSep", RECORD_END).option("recursiveFileLookup", True).text(path).where(F.btrim("value", F.lit(BLANKS)) != "")
    file = F.col("_metadata.file_path")
    return df.select(file.alias("file"), log_of(file).alias("log"), F.col("_metadata.file_block_start").alias("block_start"),
                     F.monotonically_increasing_id().alias("mid"), "value")


def number_records(records: DataFrame) -> DataFrame:
    """Add ``seq``: the gapless position from 0 of each record in its log, the
    files of a log in path order.

    The records are written once, so that splits and ids can't differ between
    the passes, as they would if the number of executors changed. The record
    index is a row a split, counted from the written rows without reading their
    text: its prefix sums are where each split starts, and ``mid`` gives the
    rank within it. A file is never a row and a log never a task.
    """
    kept = stored(records, "trace-records")
    split = ["log", "file", "block_start"]
    index = stored(kept.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("mid").alias("_first")), "trace-index")
    before = Window.partitionBy("log").orderBy("file", "block_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    return small_join(kept, starts, split, index.count()).withColumn("seq", F.col("_at") + F.col("mid")).drop("_at")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """``(log, file, block_start, mid, value, seq)``: the records of all
    logs under ``path`` and their exact order."""
    return number_records(read_records(spark, path))


def write_trace(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Render ``(name, keys, values, ret)`` rows as trace records."""
    text = df.select(render_record(F.col("name"), F.col("ret"), F.col("keys"), F.col("values"),
                                   terminator=False).alias("value"))
    text.write.mode(mode).option("lineSep", RECORD_END).text(path)


def write_logs(raw: DataFrame, path: str, key: str = "file", order: str = "seq", pieces: int | None = None,
               generation: int = 0) -> None:
    """Write rendered records (without terminator) as logs cut by size.

    A log is a folder ``file=<key>`` of pieces in path order: rows are
    range-partitioned by (key, order), so a hot log is spread over tasks. A
    later ``generation`` comes after all pieces of an earlier one.
    """
    if pieces is None:
        pieces = -(-raw.count() // PIECE_RECORDS) or 1
    piece = F.format_string(f"{generation:05d}-%010d", F.spark_partition_id())
    (raw.repartitionByRange(pieces, key, order).sortWithinPartitions(key, order)
     .select(key, piece.alias("piece"), "value").write.mode("append").partitionBy(key, "piece")
     .option("lineSep", RECORD_END).text(path))
