"""B area: success rate per length bin.

A sample row is ``(func_name, length, result)`` where ``result`` is
``'Success'`` or ``'Failure'``. Bins are half-open ``[k*w, (k+1)*w)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of the axis that are generated together.
STRETCH = 4096


def _bin_start(length: F.Column, width: int) -> F.Column:
    return (F.floor(length / F.lit(width)) * F.lit(width)).cast("bigint")


def success_by_length_bin(samples: DataFrame, width: int = 10) -> DataFrame:
    """B2: one row per non-empty bin with the success rate and the count.

    A single hash aggregate keyed by the bin start; the partial aggregate
    runs map-side, so the shuffle carries one row per (task, bin).
    """
    if width <= 0:
        raise ValueError("bin width must be positive")
    ok = (F.col("result") == F.lit("Success")).cast("double")
    return (samples
            .select(_bin_start(F.col("length"), width).alias("bin_start"), ok.alias("_ok"))
            .groupBy("bin_start")
            .agg(F.round(F.avg("_ok"), 6).alias("success_rate"),
                 F.count(F.lit(1)).alias("n_functions"))
            .withColumn("bin_end", F.col("bin_start") + F.lit(width)))


def fill_empty_bins(binned: DataFrame, width: int = 10) -> DataFrame:
    """Contiguous bins between the first and last non-empty bin.

    The axis is generated from the min/max row: first the starts of stretches
    of ``STRETCH`` bins, which are dealt out to tasks, then the bins of each.
    Its size is the value range divided by the width, never the row count, and
    no array or task holds all of it. Empty bins get ``n_functions = 0`` and a
    NULL rate.
    """
    bounds = binned.agg(F.min("bin_start").alias("lo"), F.max("bin_start").alias("hi"))
    stretches = bounds.select("hi", F.explode(F.sequence("lo", "hi", F.lit(width * STRETCH).cast("bigint"))).alias("at")).repartition("at")
    last = F.least(F.col("hi"), F.col("at") + width * (STRETCH - 1))
    axis = stretches.select(F.explode(F.sequence("at", last, F.lit(width).cast("bigint"))).alias("bin_start"))
    return (axis.join(binned.select("bin_start", "success_rate", "n_functions"), "bin_start", "left")
            .select("bin_start",
                    (F.col("bin_start") + F.lit(width)).alias("bin_end"),
                    "success_rate",
                    F.coalesce("n_functions", F.lit(0).cast("bigint")).alias("n_functions")))
