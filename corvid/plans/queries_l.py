"""L area queries: numbering, squeezing and showing lines of concatenated files."""

from pyspark.sql import functions as F

from corvid.operators import lines as L
from corvid.plans import views
from corvid.plans.catalog import register

_L = views.LINES_SQL


@register("l2_number_lines", "L", oracle=f"""
WITH {_L}
SELECT file_ord, idx, printf('%6d', row_number() OVER (ORDER BY file_ord, idx)) || chr(9) || line AS out FROM lines""")
def l2(spark, d):
    return L.number_files(views.line_files(spark, d)).select("file_ord", "idx", "out")


@register("l3_number_nonblank", "L", oracle=f"""
WITH {_L},
c AS (SELECT *, sum(CASE WHEN line <> '' THEN 1 ELSE 0 END) OVER (ORDER BY file_ord, idx ROWS UNBOUNDED PRECEDING) AS n
      FROM lines)
SELECT file_ord, idx, CASE WHEN line = '' THEN line ELSE printf('%6d', n) || chr(9) || line END AS out FROM c""")
def l3(spark, d):
    return L.number_files(views.line_files(spark, d), nonblank=True).select("file_ord", "idx", "out")


@register("l4_squeeze_blank", "L", oracle=f"""
WITH {_L},
k AS (SELECT *, lag(line) OVER (ORDER BY file_ord, idx) AS prev FROM lines),
kept AS (SELECT file_ord, idx, line FROM k WHERE NOT (line = '' AND coalesce(prev = '', FALSE)))
SELECT file_ord, idx, printf('%6d', row_number() OVER (ORDER BY file_ord, idx)) || chr(9) || line AS out FROM kept""")
def l4(spark, d):
    return L.number_files(views.line_files(spark, d), squeeze=True).select("file_ord", "idx", "out")


@register("l5_show_ends", "L", oracle=f"""
WITH {_L} SELECT file_ord, idx, regexp_replace(line, '\\r$', '^M') || '$' AS out FROM lines""")
def l5(spark, d):
    return views.lines(spark, d).select("file_ord", "idx", L.show_ends(F.col("line")).alias("out"))


@register("l6_show_tabs", "L", oracle=f"""
WITH {_L} SELECT file_ord, idx, replace(line, chr(9), '^I') AS out FROM lines""")
def l6(spark, d):
    return views.lines(spark, d).select("file_ord", "idx", L.show_tabs(F.col("line")).alias("out"))


_B = "CAST('0x' || substring(h, 2 * i + 1, 2) AS INTEGER)"
_LOW = f"({_B} & 127)"
_VIS = f"""CASE WHEN {_B} >= 128 THEN 'M-' || CASE WHEN {_LOW} < 32 THEN '^' || chr({_LOW} + 64)
                                          WHEN {_LOW} = 127 THEN '^?' ELSE chr({_LOW}) END
     WHEN {_B} = 9 THEN chr(9)
     WHEN {_B} < 32 THEN '^' || chr({_B} + 64)
     WHEN {_B} = 127 THEN '^?'
     ELSE chr({_B}) END"""
_NONPRINT = f"""{_L},
lb AS (SELECT file_ord, idx, hex(encode(line)) AS h, octet_length(encode(line)) AS n FROM lines),
vis AS (SELECT file_ord, idx, array_to_string(list_transform(generate_series(0, n - 1), lambda i: {_VIS}), '') AS v
        FROM lb)"""


@register("l7_show_nonprinting", "L", oracle=f"""
WITH {_NONPRINT} SELECT file_ord, idx, v AS out FROM vis""")
def l7(spark, d):
    return views.lines(spark, d).select("file_ord", "idx", L.show_nonprinting(F.col("line")).alias("out"))


@register("l8_show_all", "L", oracle=f"""
WITH {_NONPRINT} SELECT file_ord, idx, regexp_replace(replace(v, chr(9), '^I'), '\\r$', '^M') || '$' AS out FROM vis""")
def l8(spark, d):
    return views.lines(spark, d).select("file_ord", "idx", L.show_all(F.col("line")).alias("out"))
