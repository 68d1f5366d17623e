"""Mixing sources to target weights by capped water-filling.

A source's share of the words is its weight's share, but no source may be
repeated more than ``max_epochs`` times: such a source is clamped there and
what it gives up is dealt to the others by weight, until nothing changes.
Every document is then repeated a whole number of times, and a seeded part of
each source once more, so that the source's words come near its target.

Defined results: a null text has no words (size 0) and is taken as often as
its source; a null source is a source of its own, after all others; rows with
equal ids share their fate; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm.common import blank_words, keep, seeded_hash, small_join, unwrapped, wrapped
from corvid.plans.ordering import with_global_position

#: Hash buckets per source in the search for the cut.
BUCKETS = 4096
#: A document above this part of its source is dealt before the others.
BIG_PART = 64


def cyclic_weights(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Give the sources, by code point and null last, the weights in turn."""
    ranked = with_global_position(sizes, [F.col("_src").asc_nulls_last()], "_rank")
    values = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("_weight", F.get(values, (F.col("_rank") % len(weights)).cast("int"))).drop("_rank")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add ``_target`` to rows of (_size, _weight): the weight's share of
    ``total``, clamped at ``max_epochs`` times the size.

    One small aggregate a round; a round without a new clamped source ends it.
    """
    cap = F.col("_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        over = F.col("_weight") * F.lit(level) > cap
        row = sources.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("capped"),
                          F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0.0)).alias("free"),
                          F.count(F.when(over, True)).alias("n")).first()
        if row["n"] == clamped or not row["free"]:
            break
        level, clamped = (total - row["capped"]) / row["free"], row["n"]
    fair = F.col("_weight") * F.lit(level)
    return sources.withColumn("_target", F.when(fair > cap, cap).otherwise(fair))


def _prefix(rows: DataFrame, goal: Column, before: Column) -> Column:
    """True while taking the row brings the running size nearer to ``goal``."""
    w = Window.partitionBy("_src").orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return before + F.sum("_n").over(w) - F.col("_n") / 2 <= goal


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
             weights: Sequence[float] | DataFrame = (5, 2, 1), max_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """One row per source: size, weight, target, whole repetitions, and the
    hash cuts below which a document is taken once more.

    ``weights`` is a cycle over the sorted sources or a frame (source, weight).
    Big documents (over 1/64 of their source, so fewer than 64 of them) are
    cut first; the others are cut so that they make up for the difference.
    Only sums by hash bucket are shuffled, then the rows of one bucket a source.
    """
    rows = keep(docs.select(F.col(source).alias("_src"), F.size(blank_words(F.col(text))).cast("bigint").alias("_words"),
                            seeded_hash(seed, F.col(key)).alias("_h")))
    sizes = keep(rows.groupBy("_src").agg(F.sum("_words").alias("_size")))
    if isinstance(weights, DataFrame):
        w = weights.select(F.col(weights.columns[0]).alias("_s"), F.col(weights.columns[1]).cast("double").alias("_weight"))
        weighted = sizes.join(w, F.col("_src").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["_weight"])
    else:
        weighted = cyclic_weights(sizes, weights)
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    plan = water_fill(keep(weighted), float(total), max_epochs)
    whole = F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(0)
    plan = keep(plan.withColumn("_whole", F.least(whole, F.lit(int(max_epochs))).cast("bigint"))
                .withColumn("_rest", F.col("_target") - F.col("_whole") * F.col("_size")))
    n = plan.count()

    def with_plan(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnRenamed("_src", "_s")
        return small_join(left, r, F.col("_src").eqNullSafe(F.col("_s")), n).drop("_s")

    sized = with_plan(rows, plan.select("_src", "_size", "_rest")).filter(F.col("_words") > 0)
    big = F.col("_words") * BIG_PART > F.col("_size")
    # big documents: fewer than BIG_PART rows a source
    bigs = sized.filter(big).groupBy("_src", "_h").agg(
        F.sum("_words").alias("_n"), F.first("_rest").alias("_rest"), F.first("_size").alias("_size"))
    all_big = Window.partitionBy("_src")
    goal = F.col("_rest") * F.sum("_n").over(all_big) / F.col("_size")
    bigs = bigs.withColumn("_in", _prefix(bigs, goal, F.lit(0))).groupBy("_src").agg(
        F.sum(F.when(F.col("_in"), F.col("_n"))).alias("_got"), F.max(F.when(F.col("_in"), F.col("_h"))).alias("_big_cut"))
    goals = with_plan(plan, bigs).union(
        plan.join(bigs.withColumnRenamed("_src", "_s"), F.col("_src").eqNullSafe(F.col("_s")), "left_anti")
            .withColumns({"_got": F.lit(None).cast("bigint"), "_big_cut": F.lit(None).cast("bigint")}))
    goals = keep(goals.withColumn("_goal", F.greatest(F.lit(0.0), F.col("_rest") - F.coalesce("_got", F.lit(0)))))
    # the others: sums by bucket, the first bucket that passes the goal, its rows
    small = sized.filter(~big).withColumn("_b", F.shiftright("_h", 60 - 12).cast("int"))
    up_to = Window.partitionBy("_src").orderBy("_b")
    sums = small.groupBy("_src", "_b").agg(F.sum("_words").alias("_sum")).withColumn("_cum", F.sum("_sum").over(up_to))
    edge = with_plan(sums, goals.select("_src", "_goal")).filter(
        (F.col("_cum") > F.col("_goal")) & (F.col("_cum") - F.col("_sum") <= F.col("_goal")))
    edge = keep(edge.groupBy("_src").agg(F.min("_b").alias("_eb"), F.min(F.col("_cum") - F.col("_sum")).alias("_before"),
                                         F.first("_goal").alias("_goal")))
    at_edge = with_plan(small.select("_src", "_h", "_words", "_b"), edge).filter(F.col("_b") == F.col("_eb"))
    at_edge = at_edge.groupBy("_src", "_h").agg(F.sum("_words").alias("_n"), F.first("_before").alias("_before"),
                                               F.first("_goal").alias("_goal"))
    at_edge = at_edge.withColumn("_in", _prefix(at_edge, F.col("_goal"), F.col("_before")))
    cut = at_edge.groupBy("_src").agg(F.max(F.when(F.col("_in"), F.col("_h"))).alias("_cut"))
    cuts = with_plan(edge, cut).select(
        F.col("_src").alias("_s"), F.coalesce("_cut", F.shiftleft(F.col("_eb").cast("bigint"), 60 - 12) - 1).alias("_small_cut"))
    out = goals.join(cuts, F.col("_src").eqNullSafe(F.col("_s")), "left").drop("_s")
    # no edge bucket: the goal is not below all that there is; no goal: nothing is taken once more
    small_cut = F.when(F.col("_goal") > 0, F.coalesce("_small_cut", F.lit(1 << 60))).otherwise(F.lit(-1))
    return keep(out.select("_src", "_size", "_weight", "_target", "_whole",
                           F.coalesce("_big_cut", F.lit(-1)).alias("_big_cut"),
                           small_cut.alias("_small_cut")))


def _mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
           weights: Sequence[float] | DataFrame = (5, 2, 1), max_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    plan = mix_plan(docs, text, source, key, weights, max_epochs, seed)
    x = wrapped(docs, mix_size=F.size(blank_words(F.col(text))).cast("bigint"), _h=seeded_hash(seed, F.col(key)), _s=F.col(source))
    x = small_join(x, plan, F.col("_s").eqNullSafe(F.col("_src")), plan.count())
    is_big = F.col("mix_size") * BIG_PART > F.col("_size")
    extra = F.col("_h") <= F.when(is_big, F.col("_big_cut")).otherwise(F.col("_small_cut"))
    return x.select("_row", "mix_size", F.col("_size").alias("mix_source_size"), F.col("_target").alias("mix_target"),
                    (F.col("_whole") + extra.cast("bigint")).alias("mix_copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The documents with ``mix_size``, ``mix_source_size``, ``mix_target`` and
    ``mix_copies``: how often the mix takes the document (0 and more). Options
    are those of ``mix_plan``."""
    return unwrapped(_mixed(docs, **options), "mix_size", "mix_source_size", "mix_target", "mix_copies")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the
    columns of ``docs``. No row is shuffled."""
    times = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    return unwrapped(_mixed(docs, **options).filter("mix_copies > 0").select("_row", times.alias("_copy")))
