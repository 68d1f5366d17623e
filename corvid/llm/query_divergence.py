from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.common import documents
from corvid.llm.divergence import audit_divergence
from corvid.llm.registry import query

ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words,
         row_number() OVER () AS id FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT lang, source, id, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(ln) AS nl FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS ng FROM c GROUP BY ALL),
z AS (SELECT g.lang, g.source, coalesce(ng, 0)::HUGEINT AS ng, coalesce(v, 0)::HUGEINT AS v, coalesce(nl, 0)::HUGEINT AS nl
      FROM g LEFT JOIN t USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT z.lang, z.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (z.ng + 2 * z.v) AS p,
             1 + (1000000000::HUGEINT * (k.ln + 2)) // (z.nl + 2 * z.v) AS q
      FROM z JOIN k USING (lang) LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT x.lang, x.source, y.source AS item, coalesce(value, 0)::BIGINT AS value
       FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
       LEFT JOIN pv ON pv.lang = x.lang AND pv.source = x.source AND pv.item = y.source),
tv AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
tr AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM tv)
SELECT lang, source, 'pair' AS part, item, value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM pr
UNION ALL SELECT lang, source, 'term', item, value, rank::INT FROM tr WHERE rank <= 10
"""


@query("op11_divergence", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each language against each other and their leading terms."""
    return audit_divergence(documents(spark, sf_dir))
