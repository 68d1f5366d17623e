"""Z area queries: histograms, entropy, back-references, runs, checksums, chunks."""

from pyspark.sql import functions as F

from corvid.functions import bytes as BF
from corvid.operators import bytes as Z
from corvid.plans import views
from corvid.plans.catalog import register
from corvid.sources.tables import table

K = ["doc_id"]


def _char_hist(df):
    return Z.text_histogram(df, K)


@register("z3_symbol_histogram", "Z", oracle=f"""
WITH {views.CHARS_SQL}
SELECT doc_id, symbol, count(*) AS count FROM chars GROUP BY ALL""")
def z3(spark, d):
    return _char_hist(views.documents_text(spark, d))


@register("z4_entropy_bits", "Z", oracle=f"""
WITH {views.CHARS_SQL},
h AS (SELECT doc_id, symbol, count(*) AS cnt FROM chars GROUP BY ALL),
t AS (SELECT doc_id, sum(cnt) AS s FROM h GROUP BY doc_id),
b AS (SELECT h.doc_id, h.cnt, CASE WHEN log2(t.s) - log2(h.cnt) > -1e-5 AND log2(t.s) - log2(h.cnt) < 0 THEN 0.0
                                   ELSE log2(t.s) - log2(h.cnt) END AS bits
      FROM h JOIN t USING (doc_id))
SELECT doc_id, round(sum(cnt * bits), 6) AS total_bits FROM b GROUP BY doc_id""")
def z4(spark, d):
    _, total = Z.entropy_bits(_char_hist(views.documents_text(spark, d)), K)
    return total.withColumn("total_bits", F.round("total_bits", 6))


@register("z5_merge_histograms", "Z", oracle="""
WITH h1 AS (SELECT symbol, count(*) AS c FROM (
              SELECT unnest(string_split(d.text, '')) AS symbol FROM documents d JOIN labels l USING (doc_id)
              WHERE l.quality = 1) GROUP BY symbol),
h2 AS (SELECT symbol, count(*) AS c FROM (SELECT unnest(string_split(text, '')) AS symbol FROM benchmark)
       GROUP BY symbol)
SELECT coalesce(h1.symbol, h2.symbol) AS symbol,
       CAST(trunc(coalesce(h1.c, 0) * 0.5 + coalesce(h2.c, 0) * 1.5) AS BIGINT) AS count
FROM h1 FULL OUTER JOIN h2 ON h1.symbol = h2.symbol""")
def z5(spark, d):
    good = table(spark, d, "labels").where(F.col("quality") == 1).select("doc_id")
    # counts per document first: no text is joined
    per_doc = Z.text_histogram(views.documents_text(spark, d), K)
    h1 = per_doc.join(good, "doc_id", "left_semi").groupBy("symbol").agg(F.sum("count").alias("count"))
    bench = table(spark, d, "benchmark").withColumn("g", F.lit(0))
    h2 = Z.symbol_histogram(bench, ["g"], BF.characters(F.col("text"))).drop("g")
    return Z.merge_histograms(h1, 0.5, h2, 1.5)


_VARIANTS_SQL = """variants AS (
  SELECT doc_id, 0 AS ordinal, 'raw' AS name, octet_length(encode(text)) AS size, TRUE AS auto FROM documents
  UNION ALL SELECT doc_id, 1, 'squeezed', octet_length(encode(regexp_replace(text, '\\s+', ' ', 'g'))), TRUE FROM documents
  UNION ALL SELECT doc_id, 2, 'lower', octet_length(encode(lower(text))), TRUE FROM documents
  UNION ALL SELECT doc_id, 3, 'no_digits', octet_length(encode(regexp_replace(text, '[0-9]', '', 'g'))), TRUE FROM documents
  UNION ALL SELECT doc_id, 4, 'brute', octet_length(encode(text)) - 1000000, FALSE FROM documents)"""


@register("z6_pick_smallest", "Z", oracle=f"""
WITH {_VARIANTS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size, ordinal) AS rn FROM variants WHERE auto)
SELECT doc_id, name, size, ordinal FROM r WHERE rn = 1""")
def z6(spark, d):
    sizes = [(0, "raw", F.octet_length("text")), (1, "squeezed", F.octet_length(F.regexp_replace("text", r"\s+", " "))),
             (2, "lower", F.octet_length(F.lower("text"))), (3, "no_digits", F.octet_length(F.regexp_replace("text", "[0-9]", "")))]
    m = views.documents_text(spark, d).select("doc_id", Z.pick_smallest_in_row(sizes).alias("m"))
    return m.select("doc_id", "m.name", "m.size", "m.ordinal")


@register("z7_previous_occurrence", "Z", oracle=f"""
WITH {views.KGRAM_SQL}
SELECT doc_id, count(*) AS n_matched, CAST(sum(dist) AS BIGINT) AS sum_dist, CAST(max(dist) AS BIGINT) AS max_dist
FROM matches GROUP BY doc_id""")
def z7(spark, d):
    m = views.documents_text(spark, d).select("doc_id", Z.match_summary_in_row(F.col("text"), 3).alias("m")).where("m.n > 0")
    return m.select("doc_id", F.col("m.n").alias("n_matched"), F.col("m.sum").alias("sum_dist"), F.col("m.max").alias("max_dist"))


@register("z8_repeated_spans", "Z", oracle=f"""
WITH {views.KGRAM_SQL},
isl AS (SELECT doc_id, pos, dist, pos - row_number() OVER (PARTITION BY doc_id, dist ORDER BY pos) AS isl FROM matches),
sp AS (SELECT doc_id, dist, min(pos) AS start, count(*) + 2 AS length FROM isl GROUP BY doc_id, dist, isl)
SELECT doc_id, count(*) AS n_spans, CAST(sum(length) AS BIGINT) AS covered, CAST(max(length) AS BIGINT) AS longest
FROM sp GROUP BY doc_id""")
def z8(spark, d):
    m = views.documents_text(spark, d).select("doc_id", Z.span_summary_in_row(F.col("text"), 3).alias("m")).where("m.n > 0")
    return m.select("doc_id", F.col("m.n").alias("n_spans"), F.col("m.sum").alias("covered"), F.col("m.max").alias("longest"))


def _byte_hist(spark, d):
    t = views.documents_text(spark, d).where(F.length("text") > 0)
    rows = t.select("doc_id", Z.byte_histogram_in_row(BF.utf8(F.col("text"))).alias("h"))
    flat = Z.explode_struct_arrays(rows, K, "h", ["symbol", "count"])
    return flat.groupBy(*K, "symbol").agg(F.sum("count").alias("count"))


@register("z9_run_lengths", "Z", oracle=f"""
WITH {views.BYTES_SQL},
h AS (SELECT doc_id, b AS symbol, count(*) AS cnt FROM bytes GROUP BY ALL),
axis AS (SELECT doc_id, unnest(generate_series(0, 255)) AS symbol FROM (SELECT DISTINCT doc_id FROM h)),
full_h AS (SELECT a.doc_id, a.symbol, coalesce(h.cnt, 0) AS count FROM axis a LEFT JOIN h USING (doc_id, symbol)),
isl AS (SELECT *, symbol - row_number() OVER (PARTITION BY doc_id, count ORDER BY symbol) AS isl FROM full_h),
runs AS (SELECT doc_id, count, min(symbol) AS start, count(*) AS run_length FROM isl GROUP BY doc_id, count, isl)
SELECT doc_id, count, CAST(start AS INTEGER) AS start, run_length,
       CASE WHEN count = 0 THEN run_length >= 5 ELSE run_length >= 7 END AS collapsible
FROM runs""")
def z9(spark, d):
    return Z.run_lengths(_byte_hist(spark, d), K)


@register("z10_range_histogram", "Z", oracle=f"""
WITH {views.CHARS_SQL},
rg AS (SELECT doc_id, length(text) // 4 AS lo, 3 * length(text) // 4 AS hi FROM documents)
SELECT c.doc_id, c.symbol, count(*) AS count FROM chars c JOIN rg USING (doc_id)
WHERE c.pos >= rg.lo AND c.pos < rg.hi GROUP BY ALL""")
def z10(spark, d):
    n = F.length("text")
    return Z.range_histogram_in_row(views.documents_text(spark, d), K, BF.characters(F.col("text")),
                                    F.floor(n / 4), F.floor(3 * n / 4))


_RANGES = 10


@register("z10_many_ranges", "Z", oracle=f"""
WITH {views.CHARS_SQL},
rg AS (SELECT doc_id, CAST(i AS INTEGER) AS range_no, length(text) * i // {2 * _RANGES} AS lo, length(text) * (i + {_RANGES}) // {2 * _RANGES} AS hi
       FROM documents, range({_RANGES}) r(i))
SELECT c.doc_id, rg.range_no, c.symbol, count(*) AS count FROM chars c JOIN rg USING (doc_id)
WHERE c.pos >= rg.lo AND c.pos < rg.hi GROUP BY ALL""")
def z10_many(spark, d):
    """Z10 for ten overlapping ranges of every document."""
    n, at = F.length("text").cast("bigint"), F.sequence(F.lit(0), F.lit(_RANGES - 1))
    lows = F.transform(at, lambda i: F.floor(n * i / (2 * _RANGES)))
    highs = F.transform(at, lambda i: F.floor(n * (i + _RANGES) / (2 * _RANGES)))
    return Z.range_histograms_in_row(views.documents_text(spark, d), K, "text", lows, highs)


# The 256 table values come from their rule; the bytes are folded over them.
@register("z13_crc32", "Z", oracle="""
WITH tbl AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
bl AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda z: CAST('0x' || z AS BIGINT)) AS b
       FROM documents)
SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])),
                   4294967295::BIGINT) AS crc32
FROM bl, tbl""")
def z13(spark, d):
    t = views.documents_text(spark, d)
    return t.select("doc_id", BF.crc32(BF.utf8(F.col("text"))).alias("crc32"))


@register("z14_adler32", "Z", oracle=f"""
WITH {views.BYTES_SQL}
SELECT doc_id, CAST(((any_value(n) + sum((n - pos) * b)) % 65521) * 65536 + (1 + sum(b)) % 65521 AS BIGINT) AS adler32
FROM bytes GROUP BY doc_id""")
def z14(spark, d):
    t = views.documents_text(spark, d)
    return t.select("doc_id", BF.adler32_vectorized(BF.utf8(F.col("text"))).alias("adler32"))


@register("z16_distance_bucket", "Z", oracle=f"""
WITH {views.KGRAM_SQL}
SELECT CAST(CASE WHEN dist < 5 THEN dist - 1
            ELSE 2 * (length(bin(dist - 1)) - 1) + (((dist - 1) >> (length(bin(dist - 1)) - 2)) & 1) END AS INTEGER) AS bucket,
       CAST(CASE WHEN dist < 5 THEN 0 ELSE length(bin(dist - 1)) - 2 END AS INTEGER) AS extra_bits,
       count(*) AS n
FROM matches GROUP BY ALL""")
def z16(spark, d):
    rows = views.documents_text(spark, d).select(Z.distance_histogram_in_row(F.col("text"), 3).alias("h"))
    flat = Z.explode_struct_arrays(rows, [], "h", ["symbol", "count"])
    return (flat.groupBy(BF.distance_bucket(F.col("symbol")).alias("bucket"),
                         BF.distance_extra_bits(F.col("symbol")).alias("extra_bits"))
            .agg(F.sum("count").alias("n")))


@register("z18_percent_removed", "Z", oracle="""
WITH s AS (SELECT page_id, octet_length(encode(html)) AS in_size,
                  octet_length(encode(regexp_replace(html, '<[^>]*>', '', 'g'))) AS out_size FROM pages)
SELECT page_id, in_size, out_size, round(100.0 * (in_size - out_size) / in_size, 3) AS percent_removed,
       round(out_size * 100.0 / in_size, 3) AS percent_of_original,
       CAST(in_size // 1024 AS BIGINT) AS in_k, CAST(out_size // 1024 AS BIGINT) AS out_k
FROM s""")
def z18(spark, d):
    p = table(spark, d, "pages")
    s = p.select("page_id", F.octet_length("html").cast("bigint").alias("in_size"),
                 F.octet_length(F.regexp_replace("html", "<[^>]*>", "")).cast("bigint").alias("out_size"))
    i, o = F.col("in_size"), F.col("out_size")
    return s.select("page_id", "in_size", "out_size", BF.percent_removed(i, o).alias("percent_removed"),
                    BF.percent_of_original(i, o).alias("percent_of_original"),
                    BF.kib(i).alias("in_k"), BF.kib(o).alias("out_k"))


CHUNK = 1000


@register("z19_chunk", "Z", oracle=f"""
WITH c AS (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), {CHUNK})) AS off FROM documents),
n AS (SELECT doc_id, off, substring(text, off + 1, {CHUNK}) AS piece,
             row_number() OVER (PARTITION BY doc_id ORDER BY off) - 1 AS chunk_no FROM c)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(off AS INTEGER) AS offset,
       CAST(length(piece) AS INTEGER) AS length, md5(piece) AS md5
FROM n""")
def z19(spark, d):
    c = Z.chunk(views.documents_text(spark, d), K, "text", CHUNK)
    return c.select("doc_id", "chunk_no", "offset", F.length("piece").alias("length"), F.md5("piece").alias("md5"))
