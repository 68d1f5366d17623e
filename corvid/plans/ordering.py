"""Exact global positions without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.session import shared_path

BROADCAST_ROWS = 200_000
#: Rows of a partition where a task sorts or hashes them.
TASK_ROWS = 250_000


def with_global_position(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Add a 0-based position in the total order ``order``.

    The frame is range-partitioned and sorted, tagged with its partition id
    and a per-partition increasing id, and materialised (so the count pass
    and the final pass see the same ids). Per-partition counts are
    one row per partition; their prefix sum is the offset of each partition.
    ``order`` must be a total order for the positions to be deterministic.
    """
    sorted_df = materialize(df.orderBy(*order)
                            .withColumn("_pid", F.spark_partition_id())
                            .withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_base"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a tiny frame, so the unpartitioned window is cheap
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = sorted_df.join(F.broadcast(offsets.select("_pid", "_off", "_base")), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_base")).cast("bigint")) \
              .drop("_pid", "_mid", "_off", "_base", "_n")


def blocked_running_sum(df: DataFrame, partition: Sequence[str], order: str, value: Column,
                        out: str, block_size: int = 1 << 20) -> DataFrame:
    """Exact running sum of ``value`` per ``partition`` in ``order``, skew-safe.

    One partition key may hold a large share of all rows, so no window is
    partitioned by it alone. Rows are cut into blocks of ``block_size`` order
    values (``order`` is numeric). One window pass over (key, block) gives the
    in-block running sum, whose last value is the block total; the exclusive
    prefix of block totals per key is a window over one row per block; the
    offsets join back on (key, block), a partitioning the rows already have.
    The input is read once (the branches share the (key, block) exchange).
    """
    blk = F.floor(F.col(order) / F.lit(block_size)).cast("bigint")
    x = df.withColumn("_blk", blk).withColumn("_v", value)
    wi = Window.partitionBy(*partition, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x1 = x.withColumn("_run", F.sum("_v").over(wi))
    totals = x1.groupBy(*partition, "_blk").agg(F.max_by("_run", order).alias("_t"))
    wb = Window.partitionBy(*partition).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.withColumn("_off", F.coalesce(F.sum("_t").over(wb), F.lit(0))).drop("_t")
    return (x1.join(offs, [*partition, "_blk"])
            .withColumn(out, F.col("_off") + F.col("_run"))
            .drop("_blk", "_v", "_off", "_run"))


def materialize(df: DataFrame, name: str = "frame") -> DataFrame:
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``
    (never a local checkpoint), so the result survives executor loss.

    Measured on the per-round frames of the graph loops, a plain eager
    checkpoint beat both persist-then-checkpoint and a parquet round trip.
    ``name`` documents the call site.
    """
    from corvid.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_for(rows: int) -> int:
    """Partitions that leave about ``TASK_ROWS`` of the rows to each."""
    return max(1, -(-rows // TASK_ROWS))


@contextmanager
def shuffles_by_rows(spark: SparkSession, rows: int):
    """Shuffles of the jobs run inside have ``partitions_for(rows)`` partitions.

    Partitions are otherwise merged up to a size in compressed bytes, and rows
    that compress a hundredfold (edges to one node) fill a task's memory. Only
    for jobs that end inside: the session's settings are put back behind them.
    """
    put = {"spark.sql.shuffle.partitions": str(partitions_for(rows)),
           "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a compressed table in the shared folder: what a later
    pass reads is what was written, column by column."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_join(left: DataFrame, right: DataFrame, on, rows: int, how: str = "inner") -> DataFrame:
    """Join with a counted right side of narrow rows: broadcast up to
    ``BROADCAST_ROWS`` of them, else as the planner and AQE choose."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)
