from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import documents
from corvid.llm.mixing import mix_sources
from corvid.llm.registry import query

ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS ss,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY ss / w, source NULLS LAST) AS k,
         coalesce(sum(3.0 * ss) OVER (ORDER BY ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
         sum(w) OVER (ORDER BY ss / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
         (sum(ss) OVER ())::DOUBLE AS total
  FROM s),
lv AS (SELECT (total - capped) / free AS lvl FROM o WHERE w * ((total - capped) / free) <= 3.0 * ss ORDER BY k LIMIT 1),
p AS (
  SELECT source, ss, least(w * lvl, 3.0::DOUBLE * ss)::DOUBLE AS target FROM s, lv),
q AS (
  SELECT *, CASE WHEN ss > 0 THEN least(floor(target / ss), 3)::BIGINT ELSE 0 END AS whole FROM p),
r AS (
  SELECT d.*, q.ss, q.target, q.whole, q.target - q.whole * q.ss AS rest, d.size * 64 > q.ss AS big
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (
  SELECT doc_id, source, size,
         sum(size) OVER (PARTITION BY source ORDER BY h) - size / 2.0
           <= rest * (sum(size) OVER (PARTITION BY source)) / ss AS extra
  FROM r WHERE big),
g AS (SELECT source, sum(size) AS got FROM b WHERE extra GROUP BY source),
t AS (
  SELECT r.doc_id, r.h, r.source, r.size,
         CASE WHEN greatest(0, r.rest - coalesce(g.got, 0)) = 0 THEN NULL ELSE r.rest - coalesce(g.got, 0) END AS goal,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h) - r.size / 2.0 AS mid
  FROM r LEFT JOIN g ON r.source IS NOT DISTINCT FROM g.source WHERE NOT r.big)
SELECT r.doc_id, r.size, r.ss AS source_size, r.target,
       r.size * (r.whole + CASE WHEN r.big THEN b.extra::INT ELSE coalesce(t.mid <= t.goal, false)::INT END)::BIGINT AS taken
FROM r LEFT JOIN b ON r.doc_id = b.doc_id LEFT JOIN t ON r.doc_id = t.doc_id
"""


@query("op1_mixing", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents, weights 5, 2, 1 over the sources, at most 3 epochs."""
    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
