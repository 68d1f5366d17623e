"""L1: lines of many files in a given order, with exact numbers.

The order of the files is a table (path, file_ord). It is joined to the split
index, a row per file split, never to lines; a path listed twice has its lines
twice. What the index then holds for each split is a number, which the lines of
the split pick up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.plans.ordering import blocked_running_sum, small_join, stored, with_global_position
from corvid.sources.blobs import plain_path


def listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The order table of a list of paths."""
    return spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, file_ord bigint").select(
        F.regexp_replace("path", r"^file:(//)?", "").alias("path"), "file_ord")


def concat_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """L1, unnumbered: ``(file_ord, path, split_start, mid, line)``; order key
    is ``(file_ord, split_start, mid)``, ``mid`` growing within a split."""
    order = listed(spark, paths)
    lines = _split_lines(spark, list(dict.fromkeys(paths))).withColumnRenamed("line_path", "path")
    return small_join(lines, order, "path", len(paths)).select("file_ord", "path", "split_start", "mid", "line")


def _split_lines(spark: SparkSession, roots: str | Sequence[str]) -> DataFrame:
    df = spark.read.option("lineSep", "\n").text(roots)
    return df.select(plain_path(F.col("_metadata.file_path")).alias("line_path"),
                     F.col("_metadata.file_block_start").alias("split_start"),
                     F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, roots: str | Sequence[str], order: DataFrame | None = None) -> DataFrame:
    """L1: ``(file_ord, path, idx, n, line)`` of the files below ``roots`` that
    ``order`` (path, file_ord) lists: ``idx`` counts from 0 in the file, ``n``
    from 1 through all files in order. Without ``order`` the roots are the files.

    Lines end at newlines; a last line without one ends with its file. The text
    is written once, so that splits can't differ between the passes; the index
    is counted from the written rows without their text.
    """
    order = listed(spark, [roots] if isinstance(roots, str) else roots) if order is None else order
    files = roots if isinstance(roots, str) else list(dict.fromkeys(roots))
    kept = stored(_split_lines(spark, files), "ordered-lines")
    split = ["line_path", "split_start"]
    counts = kept.groupBy(*split).agg(F.count(F.lit(1)).alias("_lines"), F.min("mid").alias("_first"))
    index = counts.join(order.select(F.col("path").alias("line_path"), "file_ord"), "line_path")
    placed = stored(with_global_position(index, ["file_ord", "split_start"], "_p"), "split-index")
    up_to = stored(blocked_running_sum(placed, [], "_p", F.col("_lines"), "_to"), "split-ends")
    before = up_to.withColumn("_before", F.col("_to") - F.col("_lines"))
    # a file's first split tells where the file starts
    starts = before.where("split_start = 0").select("file_ord", F.col("_before").alias("_file"))
    places = before.join(starts, "file_ord").select(*split, "file_ord", "_file", (F.col("_before") - F.col("_first")).alias("_at"))
    rows = small_join(kept, places, split, up_to.count())
    at = F.col("_at") + F.col("mid")
    return rows.select("file_ord", F.col("line_path").alias("path"), (at - F.col("_file")).alias("idx"), (at + 1).alias("n"), "line")
