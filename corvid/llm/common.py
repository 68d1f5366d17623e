"""Column helpers and materialisation shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.session import ensure_checkpoint_dir
from corvid.sources.tables import table

# Fixed value: the six white-space characters that part words.
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A frame of at most this many rows may be broadcast; its rows are narrow.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` is many times faster than ``translate`` and gives the same
    string unless the text holds another upper-case or title-case letter.
    """
    other = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(other, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def blank_words(text: Column) -> Column:
    """Words between blanks, in order; an empty array for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[ \t-\r]+"))


def seeded_hash(seed: int, key: Column) -> Column:
    """Non-negative 60-bit hash of ``key`` under ``seed`` (null counts as empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def keep(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, for written tables and files."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table written to the shared folder (smaller than a
    checkpoint, which is neither encoded nor compressed)."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a table of this run that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Collect what no frame refers to any more, here and in the driver's JVM.

    Spark deletes the shuffle files and broadcasts of a frame only when the
    driver has collected its handle, which a driver with room to spare may put
    off for half an hour; a job of many rounds would hold all of them.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()


def wrapped(docs: DataFrame, **named: Column) -> DataFrame:
    """The rows as one struct ``_row`` beside the named columns, so that no
    column of the input meets an internal name."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in named.items()])


def unwrapped(df: DataFrame, *new: str) -> DataFrame:
    """The input's columns and the new ones; a new one takes the place of an
    input column of the same name."""
    taken = {n.lower() for n in new}
    own = [n for n in df.schema["_row"].dataType.names if n.lower() not in taken]
    return df.select(*[F.col("_row")[n].alias(n) for n in own], *new)


def small_join(left: DataFrame, right: DataFrame, on, rows: int, how: str = "inner") -> DataFrame:
    """Join with a counted right side: broadcast it up to ``BROADCAST_ROWS``
    rows, else leave the choice and the skew to the planner."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)
