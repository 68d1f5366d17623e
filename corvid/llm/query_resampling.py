from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.common import documents
from corvid.llm.registry import query
from corvid.llm.resampling import resample
from corvid.sources.tables import table

# CRC-32 of each distinct word: the 256 table values come from their rule.
ORACLE = r"""
WITH tbl AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
m AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS w FROM d),
bytes AS (
  SELECT w, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda z: CAST('0x' || z AS BIGINT)) AS b
  FROM (SELECT w FROM dw UNION SELECT w FROM m)),
wb AS (
  SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])),
                4294967295::BIGINT) % 10000 AS bucket FROM bytes, tbl),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN wb USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM m JOIN wb USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((s::DOUBLE + 1) * (tt + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket, sums),
f AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN wb USING (w) JOIN g USING (bucket) GROUP BY doc_id),
r AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total / n), 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (doc_id)),
x AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM r),
k AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place,
             (10 * count(*) FILTER (WHERE n_features >= 20) OVER ()) // 100 AS wanted FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM k
"""


@query("op13_resampling", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark."""
    drawn = resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
