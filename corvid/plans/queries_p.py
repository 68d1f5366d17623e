"""P area queries: colour statistics, transparent cleaning, verification,
chunks, size reports and PNG header parsing."""

from pyspark.sql import functions as F

from corvid.operators import images as P
from corvid.plans import views
from corvid.plans.catalog import register
from corvid.sources.tables import table

_PX = views.PIXELS_SQL
_PACK = "(CAST(r AS BIGINT) * 16777216 + CAST(g AS BIGINT) * 65536 + CAST(b AS BIGINT) * 256 + a)"
_RGB = "(CAST(r AS BIGINT) * 16777216 + CAST(g AS BIGINT) * 65536 + CAST(b AS BIGINT) * 256)"


def _bits(v):
    return f"CASE WHEN {v} = 0 OR {v} = 255 THEN 1 WHEN {v} % 85 = 0 THEN 2 WHEN {v} % 17 = 0 THEN 4 ELSE 8 END"


_PROFILE_SQL = f"""{_PX},
f AS (SELECT image_id, bool_or(r <> g OR r <> b) AS coloured, bool_or(a > 0 AND a < 255) AS partial, bool_or(a <> 255) AS some_alpha,
             count(DISTINCT CASE WHEN a = 0 THEN {_RGB} END) AS nk, min(CASE WHEN a = 0 THEN {_RGB} END) AS k,
             max({_bits('r')}) AS rbits, count(DISTINCT {_PACK}) AS colours, count(*) AS n_pixels
      FROM pixels GROUP BY image_id),
kp AS (
  SELECT *, nk = 1 AND NOT partial AND NOT EXISTS (
           SELECT 1 FROM pixels p WHERE p.image_id = f.image_id AND p.a = 255
             AND CAST(p.r AS BIGINT) * 16777216 + CAST(p.g AS BIGINT) * 65536 + CAST(p.b AS BIGINT) * 256 = f.k) AS key_possible
  FROM f),
profile AS (
  SELECT image_id, coloured, key_possible, some_alpha AND NOT key_possible AS alpha_needed,
         CAST(CASE WHEN coloured OR (some_alpha AND NOT key_possible) THEN 8 ELSE rbits END AS INTEGER) AS bits, colours, n_pixels
  FROM kp)"""


@register("p6_colour_counts", "P", oracle=f"""
WITH {_PX}, n AS (SELECT image_id, count(DISTINCT {_PACK}) AS colours FROM pixels GROUP BY image_id)
SELECT image_id, colours, colours <= 256 AS fits_palette FROM n""")
def p6(spark, d):
    return P.colour_counts(views.pixels(spark, d))


@register("p7_colour_profile", "P", oracle=f"""
WITH {_PROFILE_SQL} SELECT * FROM profile""")
def p7(spark, d):
    return P.colour_profile(views.pixels(spark, d))


@register("p8_minimal_colour_mode", "P", oracle=f"""
WITH {_PROFILE_SQL},
a1 AS (SELECT image_id, NOT coloured AS grey, colours, n_pixels, key_possible AND n_pixels > 16 AS key,
              alpha_needed OR (key_possible AND n_pixels <= 16) AS alpha,
              CASE WHEN coloured OR (key_possible AND n_pixels <= 16) THEN greatest(bits, 8) ELSE bits END AS bits,
              CASE WHEN colours <= 2 THEN 1 WHEN colours <= 4 THEN 2 WHEN colours <= 16 THEN 4 ELSE 8 END AS pbits FROM profile),
a2 AS (SELECT *, colours <= 256 AND bits <= 8 AND n_pixels >= 2 * colours AND NOT (grey AND NOT alpha AND bits <= pbits) AS pal FROM a1)
SELECT image_id,
       CASE WHEN pal THEN 'palette' WHEN grey AND alpha THEN 'grey+alpha' WHEN alpha THEN 'rgba' WHEN grey AND key THEN 'grey+key'
            WHEN grey THEN 'grey' WHEN key THEN 'rgb+key' ELSE 'rgb' END AS mode,
       CAST(CASE WHEN pal THEN pbits ELSE bits END AS INTEGER) AS mode_bits
FROM a2""")
def p8(spark, d):
    return P.minimal_colour_mode(P.colour_profile(views.pixels(spark, d))).select("image_id", "mode", "mode_bits")


_CLEAN_SQL = f"""{_PX},
st AS (SELECT image_id, NOT bool_or(a > 0 AND a < 255)
              OR count(DISTINCT CASE WHEN a = 0 THEN -1 ELSE {_PACK} END) <= 256 AS same FROM pixels GROUP BY image_id),
ft AS (SELECT image_id, r AS fr, g AS fg, b AS fb FROM (
         SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x) AS rn FROM pixels WHERE a = 0) WHERE rn = 1),
lo AS (SELECT p.*, last_value(CASE WHEN a <> 0 THEN r END IGNORE NULLS) OVER w AS lr,
              last_value(CASE WHEN a <> 0 THEN g END IGNORE NULLS) OVER w AS lg,
              last_value(CASE WHEN a <> 0 THEN b END IGNORE NULLS) OVER w AS lb
       FROM pixels p WINDOW w AS (PARTITION BY image_id ORDER BY y, x ROWS UNBOUNDED PRECEDING)),
cleaned AS (
  SELECT lo.image_id, x, y,
         CASE WHEN a = 0 AND same THEN ft.fr WHEN a = 0 THEN coalesce(lr, 0) ELSE r END AS r,
         CASE WHEN a = 0 AND same THEN ft.fg WHEN a = 0 THEN coalesce(lg, 0) ELSE g END AS g,
         CASE WHEN a = 0 AND same THEN ft.fb WHEN a = 0 THEN coalesce(lb, 0) ELSE b END AS b,
         a
  FROM lo JOIN st USING (image_id) LEFT JOIN ft USING (image_id))"""


def _cleaned(spark, d):
    px = views.pixels(spark, d)
    return px, P.clean_transparent(px)


@register("p9_clean_transparent", "P", oracle=f"""
WITH {_CLEAN_SQL} SELECT image_id, x, y, r, g, b, a FROM cleaned""")
def p9(spark, d):
    _, c = _cleaned(spark, d)
    return c


@register("p3_verify_pairs", "P", oracle=f"""
WITH {_CLEAN_SQL},
j AS (SELECT p.image_id, p.r = c.r AND p.g = c.g AND p.b = c.b AND p.a = c.a AS strict_eq,
             p.a = c.a AND (p.a = 0 OR (p.r = c.r AND p.g = c.g AND p.b = c.b)) AS lossy_eq
      FROM pixels p JOIN cleaned c USING (image_id, x, y))
SELECT image_id, bool_and(strict_eq) AS strict_ok, bool_and(lossy_eq) AS lossy_ok FROM j GROUP BY image_id""")
def p3(spark, d):
    px, c = _cleaned(spark, d)
    return P.verify_pairs(px, c)


WANTED = ["tEXt", "zTXt", "sRGB", "iCCP"]
_CASE_NAMES = "CASE l_returnflag || l_linestatus " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in views.CHUNK_NAMES.items()) + " END"


@register("p4_chunks_to_keep", "P", oracle=f"""
SELECT DISTINCT l_orderkey // 64 AS image_id, {_CASE_NAMES} AS name FROM lineitem
WHERE {_CASE_NAMES} IN ({", ".join(f"'{w}'" for w in WANTED)})""")
def p4(spark, d):
    return P.chunks_to_keep(views.image_chunk_names(spark, d), WANTED)


@register("p2_keep_better", "P", oracle=f"""
WITH {views.FILES_SQL}
SELECT name, CASE WHEN old_size IS NOT NULL AND out_size >= old_size AND name = out_name THEN 'old' ELSE 'new' END AS kept,
       CASE WHEN old_size IS NOT NULL AND out_size >= old_size AND name = out_name THEN old_size ELSE out_size END AS final_size
FROM files""")
def p2(spark, d):
    return P.keep_better(views.image_files(spark, d)).select("name", "kept", "final_size")


@register("p5_size_report", "P", oracle=f"""
WITH {views.FILES_SQL},
k AS (SELECT *, CASE WHEN old_size IS NOT NULL AND out_size >= old_size AND name = out_name THEN old_size ELSE out_size END AS fin FROM files)
SELECT count(*) AS tried, CAST(count_if(NOT error AND fin < in_size) AS BIGINT) AS smaller,
       CAST(count_if(NOT error AND fin = in_size) AS BIGINT) AS equal,
       CAST(count_if(error) AS BIGINT) AS errors,
       CAST(coalesce(sum(CASE WHEN NOT error AND fin < in_size THEN in_size - fin END), 0) AS BIGINT) AS saved,
       CAST(coalesce(sum(CASE WHEN NOT error THEN in_size END), 0) AS BIGINT) AS total_in,
       CAST(coalesce(sum(CASE WHEN NOT error THEN fin END), 0) AS BIGINT) AS total_out,
       round(CAST(coalesce(sum(CASE WHEN NOT error THEN fin END), 0) AS BIGINT) * 100.0
             / nullif(CAST(coalesce(sum(CASE WHEN NOT error THEN in_size END), 0) AS BIGINT), 0), 3) AS percent
FROM k""")
def p5(spark, d):
    return P.size_report(views.image_files(spark, d))


PREFIX = "opt_"


@register("p1_skip_outputs", "P", oracle=f"""
WITH f AS (SELECT 'imgs/' || CASE WHEN p_size < 10 THEN '{PREFIX}' ELSE '' END || replace(p_name, ' ', '_') || '_'
                  || CAST(p_partkey AS VARCHAR) || '.png' AS path FROM part)
SELECT path FROM f WHERE NOT starts_with(regexp_extract(path, '[^/]*$', 0), '{PREFIX}')""")
def p1(spark, d):
    p = table(spark, d, "part")
    path = F.concat(F.lit("imgs/"), F.when(F.col("p_size") < 10, F.lit(PREFIX)).otherwise(F.lit("")),
                    F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".png"))
    return P.skip_outputs(p.select(path.alias("path")), PREFIX)


def _headers(spark, d):
    px = views.pixels(spark, d)
    dims = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), F.max("y").alias("h"))
    good = P.png_bytes(F.col("w").cast("int"), F.col("h").cast("int"))
    bad_depth = P.png_bytes(F.col("w").cast("int"), F.col("h").cast("int"), depth=3)
    k = F.col("image_id") % 6
    blob = (F.when(k == 1, F.concat(F.unhex(F.lit("00")), F.expr("substring(png, 2)")))
            .when(k == 2, F.concat(F.substring("png", 1, 29), F.unhex(F.lit("00000000")), F.expr("substring(png, 34)")))
            .when(k == 3, F.substring("png", 1, 20))
            .when(k == 4, F.col("bad"))
            .otherwise(F.col("png")))
    return dims.select("image_id", good.alias("png"), bad_depth.alias("bad")).select("image_id", blob.alias("data"))


@register("p10_image_header", "P", oracle=f"""
WITH {_PX},
dims AS (SELECT image_id, max(x) + 1 AS w, max(y) AS h FROM pixels GROUP BY image_id),
e AS (SELECT image_id, w, h, CASE image_id % 6 WHEN 1 THEN 28 WHEN 2 THEN 57 WHEN 3 THEN 27 WHEN 4 THEN 37 ELSE 0 END AS error
      FROM dims)
SELECT image_id, CASE WHEN error = 0 THEN CAST(w AS BIGINT) END AS width,
       CASE WHEN error = 0 THEN CAST(h AS BIGINT) END AS height,
       CASE WHEN error = 0 THEN 8 END AS depth, CASE WHEN error = 0 THEN 6 END AS colour_type,
       CASE WHEN error = 0 THEN 0 END AS interlace, error
FROM e""")
def p10(spark, d):
    h = _headers(spark, d).select("image_id", P.image_header(F.col("data")).alias("hd"))
    return h.select("image_id", "hd.*")


@register("p11_image_chunks", "P", oracle=f"""
WITH {_PX}, imgs AS (SELECT DISTINCT image_id FROM pixels),
c(ordinal, name, anc, safe, loc) AS (VALUES (0, 'IHDR', FALSE, FALSE, 0), (1, 'tEXt', TRUE, TRUE, 0),
                                            (2, 'IDAT', FALSE, FALSE, 2), (3, 'IEND', FALSE, FALSE, 2))
SELECT i.image_id, c.ordinal, c.name,
       CAST(CASE c.name WHEN 'IHDR' THEN 13 WHEN 'tEXt' THEN 14 + length(CAST(i.image_id AS VARCHAR)) ELSE 0 END
            AS BIGINT) AS length,
       c.anc AS ancillary, FALSE AS private, c.safe AS safe_to_copy, c.loc AS location, TRUE AS crc_ok,
       CAST(NULL AS VARCHAR) AS error
FROM imgs i, c WHERE i.image_id % 5 <> 3 AND (i.image_id % 5 <> 2 OR c.ordinal < 3)
UNION ALL
SELECT image_id, CASE WHEN image_id % 5 = 2 THEN 3 ELSE 0 END, NULL, NULL, NULL, NULL, NULL, CASE WHEN image_id % 5 = 2 THEN 2 ELSE 0 END,
       NULL, 'truncated' FROM imgs WHERE image_id % 5 IN (2, 3)""")
def p11(spark, d):
    px = views.pixels(spark, d)
    dims = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), F.max("y").alias("h"))
    text = P.png_chunk("tEXt", F.encode(F.concat(F.lit("Comment\u0000image "), F.col("image_id").cast("string")), "UTF-8"))
    blob = P.png_bytes(F.col("w").cast("int"), F.col("h").cast("int"), extra_chunks=text)
    k = F.col("image_id") % 5
    # bytes after IEND, an end without IEND, and blobs of the signature alone
    data = (F.when(k == 1, F.concat("png", F.unhex(F.lit("0A0B")))).when(k == 2, F.expr("substring(png, 1, octet_length(png) - 12)"))
            .when(k == 3, F.substring("png", 1, 8)).otherwise(F.col("png")))
    return P.image_chunks(dims.select("image_id", blob.alias("png")).select("image_id", data.alias("data")))
