"""C area queries: definitions, renaming, signatures, callee sets, unit merging."""

from pyspark.sql import functions as F

from corvid.functions import code
from corvid.operators import inventory as C
from corvid.plans import views
from corvid.plans.catalog import register

_F = views.FUNCTIONS_SQL
_E = views.CALL_EDGES_SQL


@register("c3_definitions_only", "C", oracle=f"""
WITH {_F}
SELECT name, filename, start_line, end_line FROM functions
WHERE is_valid_location AND NOT is_system AND is_definition""")
def c3(spark, d):
    return C.definitions_only(views.functions(spark, d)).select("name", "filename", "start_line", "end_line")


@register("c4_rename_entry", "C", oracle=f"""
WITH {_F}
SELECT c_custkey, CASE WHEN name = 'main' THEN 'main_0' ELSE name END AS name FROM functions""")
def c4(spark, d):
    return views.functions(spark, d).select("c_custkey", code.rename_entry("name").alias("name"))


_T = "['int','char*','double']"
_N = "['argc','','x']"


@register("c5_build_signature", "C", oracle=f"""
WITH {_F}
SELECT c_custkey,
       return_type || ' ' || name || '(' ||
       array_to_string(list_transform(range(1, num_args + 1),
           lambda i: CASE WHEN {_N}[i] = '' THEN {_T}[i] ELSE {_T}[i] || ' ' || {_N}[i] END), ', ')
       || ')' AS signature
FROM functions""")
def c5(spark, d):
    f = views.functions(spark, d)
    types = F.slice(F.array(*[F.lit(t) for t in views.PARAM_TYPES]), 1, F.col("num_args"))
    names = F.slice(F.array(*[F.lit(t) for t in views.PARAM_NAMES]), 1, F.col("num_args"))
    return f.select("c_custkey", code.build_signature(F.col("return_type"), F.col("name"), types, names)
                    .alias("signature"))


@register("c6_basename", "C", oracle=f"""
WITH {_E}
SELECT caller_path, regexp_extract(caller_path, '[^/]*$', 0) AS base, count(*) AS n_edges
FROM call_edges GROUP BY caller_path""")
def c6(spark, d):
    return (views.call_edges(spark, d).groupBy("caller_path").agg(F.count(F.lit(1)).alias("n_edges"))
            .withColumn("base", code.basename("caller_path")))


@register("c7_function_length", "C", oracle=f"""
WITH {_F}
SELECT c_custkey, name, end_line - start_line + 1 AS length FROM functions""")
def c7(spark, d):
    return views.functions(spark, d).select("c_custkey", "name", code.function_length().alias("length"))


@register("c8_attach_callees", "C", oracle=f"""
WITH {_F}, {_E},
sets AS (SELECT caller, caller_path, array_to_string(list_sort(list_distinct(list(callee))), ',') AS callees
         FROM call_edges GROUP BY caller, caller_path),
m AS (SELECT f.c_custkey, f.name, f.filename, s.caller_path, s.callees,
             row_number() OVER (PARTITION BY f.c_custkey ORDER BY s.caller_path NULLS LAST) AS rn
      FROM functions f LEFT JOIN sets s
        ON f.name = s.caller
       AND regexp_extract(f.filename, '[^/]*$', 0) = regexp_extract(s.caller_path, '[^/]*$', 0))
SELECT c_custkey, name, filename, callees FROM m WHERE rn = 1""")
def c8(spark, d):
    f = views.functions(spark, d).select("c_custkey", "name", "filename")
    sets = C.callee_set(views.call_edges(spark, d), ("caller", "caller_path"))
    return (C.attach_callees(f, sets)
            .withColumn("callees", F.array_join("callees", ",")))


@register("c9_defined_callees", "C", oracle=f"""
WITH {_F}, {_E},
defs AS (SELECT name FROM functions WHERE is_valid_location AND NOT is_system AND is_definition)
SELECT caller, caller_path, callee, count(*) AS n_calls FROM call_edges
WHERE callee IN (SELECT name FROM defs) GROUP BY ALL""")
def c9(spark, d):
    defs = C.definitions_only(views.functions(spark, d))
    return (C.defined_callees(views.call_edges(spark, d), defs)
            .groupBy("caller", "caller_path", "callee").agg(F.count(F.lit(1)).alias("n_calls")))


@register("c10_merge_units", "C", oracle=f"""
WITH {_F}
SELECT DISTINCT * FROM (
  SELECT name, filename, start_line, end_line FROM functions
  UNION ALL
  SELECT name, filename, start_line, start_line + (c_custkey % 30) AS end_line FROM functions)""")
def c10(spark, d):
    f = views.functions(spark, d)
    a = f.select("name", "filename", "start_line", "end_line")
    b = f.select("name", "filename", "start_line", (F.col("start_line") + F.col("c_custkey") % 30).alias("end_line"))
    return C.merge_units(a, b)


@register("c11_callee_set", "C", oracle=f"""
WITH {_E}
SELECT caller, count(DISTINCT callee) AS n_callees,
       array_to_string(list_sort(list_distinct(list(callee))), ',') AS callees
FROM call_edges GROUP BY caller""")
def c11(spark, d):
    s = C.callee_set(views.call_edges(spark, d), ("caller",))
    return s.select("caller", F.size("callees").cast("bigint").alias("n_callees"),
                    F.array_join("callees", ",").alias("callees"))


@register("x15_first_record_per_name", "X", oracle=f"""
WITH {_F},
r AS (SELECT name, filename, start_line, end_line, start_col, end_col,
             row_number() OVER (PARTITION BY name ORDER BY filename, start_line, end_line, start_col, end_col) AS rn
      FROM functions)
SELECT name, filename, start_line, end_line, start_col, end_col FROM r WHERE rn = 1""")
def x15(spark, d):
    f = views.functions(spark, d).select("name", "filename", "start_line", "end_line", "start_col", "end_col")
    return C.first_record_per_name(f)
