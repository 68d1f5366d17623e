"""Line dedup: long lines that many documents share stay in one of them.

The hashes of the lines are range-partitioned and sorted by document (largest
first) and position, and the stream of each hash is read once: its first
document keeps the line, the later ones lose it. The result is a compressed
keep bitmap a document (the runs of kept lines), not the texts.

Defined results: a null or empty text is one empty line; a null id stands
below every other id; rows with equal ids count as one document for a line and
each gets its own bitmap; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm.common import BLANKS, ascii_lower, keep, small_join, unwrapped, wrapped

#: A hash on more lines than this (and than four mean buckets) is hot.
HOT_LINES = 2_000


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """(_id, _th, _pos, _h, _h2) of every line whose key is long enough. The key
    is the line without outer blanks, A-Z lower-cased; its 96-bit hash stands for it."""
    lines = docs.select(F.col(key).alias("_id"), F.xxhash64(F.col(text)).alias("_th"),
                        F.posexplode(line_array(F.col(text))).alias("_pos", "_line"))
    k = F.btrim("_line", F.lit(BLANKS))
    return (lines.withColumn("_key", k).filter(F.length("_key") >= min_chars)
            .withColumn("_low", ascii_lower(F.col("_key")))
            .select("_id", "_th", "_pos", F.xxhash64("_low").alias("_h"), F.hash("_low").alias("_h2")))


def hot_hashes(lines: DataFrame, min_docs: int) -> DataFrame:
    """(_h, _h2, _stays) of hot hashes in at least ``min_docs`` documents.

    Lines are first counted by hash bucket (as many rows as buckets), so only
    the hashes of full buckets are counted one by one, pre-aggregated."""
    total = lines.count()
    buckets = int(min(1 << 22, max(1 << 14, total // 50_000)))
    hot = max(HOT_LINES, 4 * total // buckets)
    b = F.pmod("_h", F.lit(buckets)).alias("_b")
    full = keep(lines.groupBy(b).count().filter(F.col("count") > hot).select("_b"))
    inside = small_join(lines.withColumn("_b", b), full, "_b", full.count(), "left_semi")
    per_doc = inside.groupBy("_h", "_h2", "_id").agg(F.count(F.lit(1)).alias("_n"))
    return keep(per_doc.groupBy("_h", "_h2").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_docs"),
                                                 F.max("_id").alias("_stays"))
                .filter((F.col("_n") > hot)).select("_h", "_h2", "_docs", "_stays"))


def dropped_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 40,
                  min_docs: int = 5) -> DataFrame:
    """(_id, _th, _pos) of the lines to drop."""
    lines = keep(line_hashes(docs, text, key, min_chars))
    hot = hot_hashes(lines, min_docs)
    n_hot = hot.count()
    # a hot hash: its largest document is known, so its lines are judged where they are
    heavy = small_join(lines, hot, ["_h", "_h2"], n_hot).filter(
        (F.col("_docs") >= min_docs) & (F.col("_id").isNull() | (F.col("_id") < F.col("_stays"))))
    rest = small_join(lines, hot, ["_h", "_h2"], n_hot, "left_anti") if n_hot else lines
    order = [F.col("_id").desc_nulls_last(), F.col("_pos")]
    stream = Window.partitionBy("_h", "_h2").orderBy(F.col("_id").desc_nulls_last())
    ranged = rest.repartitionByRange("_h").sortWithinPartitions("_h", "_h2", *order)
    ranked = ranged.withColumn("_nth", F.dense_rank().over(stream))
    docs_of = F.max("_nth").over(Window.partitionBy("_h", "_h2"))
    light = ranked.withColumn("_docs", docs_of).filter((F.col("_docs") >= min_docs) & (F.col("_nth") > 1))
    return heavy.select("_id", "_th", "_pos").union(light.select("_id", "_th", "_pos"))


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """(_id, _th, _n_dropped, _runs): for each document that loses lines, the
    runs (start, length) between its dropped lines; the last has no end (-1)."""
    lost = (dropped_lines(docs, **options).distinct().groupBy("_id", "_th")
            .agg(F.sort_array(F.collect_list("_pos")).alias("_lost")))
    runs = F.expr("""filter(transform(concat(_lost, array(-1)), (p, i) ->
        struct(CASE WHEN i = 0 THEN 0 ELSE _lost[i - 1] + 1 END AS start,
               CASE WHEN p < 0 THEN -1 WHEN i = 0 THEN p ELSE p - _lost[i - 1] - 1 END AS len)), r -> r.len <> 0)""")
    return lost.select("_id", "_th", F.size("_lost").cast("bigint").alias("_n_dropped"), runs.alias("_runs"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 40,
                min_docs: int = 5) -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped``, ``keep_runs`` and
    ``kept_text``. The bitmaps grow with the corpus, so they are joined by key
    at every size; only applying them moves the texts."""
    maps = keep_bitmaps(docs, text=text, key=key, min_chars=min_chars, min_docs=min_docs)
    x = wrapped(docs, _id0=F.col(key), _th0=F.xxhash64(F.col(text)), _text=F.col(text))
    x = x.join(maps, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_th0") == F.col("_th")), "left")
    x = x.withColumn("_lines", line_array(F.col("_text"))).withColumn("keep_runs", F.expr("""transform(
        coalesce(_runs, array(struct(0 AS start, -1 AS len))),
        r -> struct(r.start AS start, CASE WHEN r.len < 0 THEN size(_lines) - r.start ELSE r.len END AS len))"""))
    kept = F.flatten(F.transform("keep_runs", lambda r: F.slice("_lines", r["start"] + 1, r["len"])))
    x = x.withColumns({"n_lines": F.size("_lines").cast("bigint"), "kept_text": F.array_join(kept, "\n"),
                       "n_dropped": F.coalesce("_n_dropped", F.lit(0)).cast("bigint")})
    return unwrapped(x, "n_lines", "n_dropped", "keep_runs", "kept_text")
