"""T area queries: trace round trip, value rendering, runs and crashes."""

from pyspark.sql import functions as F

from corvid.functions import trace_text as TT
from corvid.operators import inventory as C
from corvid.operators import trace as T
from corvid.plans import views
from corvid.plans.catalog import register
from corvid.session import shared_path
from corvid.sources.trace_files import read_records, read_trace, write_logs, write_trace
from corvid.streaming import trace_stream as S

_TR = views.TRACE_SQL


@register("t11_parse_trace", "T", oracle=f"""
WITH {_TR}
SELECT file, seq, name, a_user AS user, a_props AS props, ret,
       CAST(CASE WHEN ret IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_ret
FROM trace""")
def t11(spark, d):
    t = views.trace(spark, d)
    return t.select("file", "seq", "name", F.col("args")["user"].alias("user"),
                    F.col("args")["props"].alias("props"), F.get("ret", 0).alias("ret"),
                    F.size("ret").alias("n_ret"))


_RENDER_SQL = """CASE WHEN ctype = 'int' THEN CAST(TRY_CAST(raw AS BIGINT) AS VARCHAR)
     WHEN ctype = 'double' THEN printf('%f', CAST(raw AS DOUBLE))
     WHEN ctype = 'char*' THEN raw
     WHEN ctype = 'void*' AND TRY_CAST(raw AS UBIGINT) = 0 THEN '(nil)'
     WHEN ctype = 'void*' THEN '0x' || lower(hex(TRY_CAST(raw AS UBIGINT)))
     ELSE '<unsupported>' END"""


@register("t3_render_value", "T", oracle=f"""
WITH {views.TYPED_SQL}
SELECT seq, ctype, {_RENDER_SQL} AS rendered FROM typed""")
def t3(spark, d):
    t = views.typed_values(spark, d)
    return t.select("seq", "ctype", TT.render_value(F.col("ctype"), F.col("raw")).alias("rendered"))


_CLASSIFY_SQL = """CASE WHEN r IS NULL THEN NULL WHEN r = '<unsupported>' THEN 'unsupported'
     WHEN r = '(nil)' OR r = '0x0' THEN 'null pointer'
     WHEN regexp_matches(r, '^0x[0-9a-f]+$') THEN 'address'
     WHEN regexp_matches(r, '^-?[0-9]+$') THEN 'integer'
     WHEN regexp_matches(r, '^-?[0-9]+\\.[0-9]{6}$') THEN 'float'
     ELSE 'text' END"""


@register("t4_classify_value", "T", oracle=f"""
WITH {views.TYPED_SQL}, rendered AS (SELECT ctype, {_RENDER_SQL} AS r FROM typed)
SELECT ctype, {_CLASSIFY_SQL} AS class, count(*) AS n FROM rendered GROUP BY ALL""")
def t4(spark, d):
    t = views.typed_values(spark, d)
    r = t.select("ctype", TT.render_value(F.col("ctype"), F.col("raw")).alias("r"))
    return r.groupBy("ctype", TT.classify_value(F.col("r")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@register("t5_redact_contents", "T", oracle=f"""
WITH {_TR}, v AS (SELECT seq, a_user AS r, a_props FROM trace)
SELECT seq, CASE WHEN ({_CLASSIFY_SQL}) = 'text' THEN '<redacted>' ELSE r END AS user,
       CASE WHEN regexp_matches(a_props, '^-?[0-9]+$') THEN a_props ELSE '<redacted>' END AS props
FROM v""")
def t5(spark, d):
    t = T.redact_contents(views.trace(spark, d))
    return t.select("seq", F.col("args")["user"].alias("user"), F.col("args")["props"].alias("props"))


_INV_SQL = f"""{views.FUNCTIONS_SQL},
inv AS (SELECT name,
               CASE WHEN return_type = 'double' THEN ['<return_val>'] || list_slice(['argc','','x'], 1, num_args)
                    ELSE list_slice(['argc','','x'], 1, num_args) END AS names
        FROM (SELECT *, row_number() OVER (PARTITION BY name
                        ORDER BY filename, start_line, end_line, start_col, end_col) AS rn FROM functions)
        WHERE rn = 1),
{views.POSITIONAL_SQL},
pj AS (SELECT p.seq, p.name, p.vals, coalesce(i.names, []) AS names FROM pos p LEFT JOIN inv i USING (name))"""


def _inventory(spark, d):
    f = C.first_record_per_name(views.functions(spark, d).select(
        "name", "filename", "start_line", "end_line", "start_col", "end_col", "num_args", "return_type"))
    return f.select("name", F.slice(F.array(*[F.lit(x) for x in views.PARAM_NAMES]), 1, F.col("num_args"))
                    .alias("param_names"), (F.col("return_type") == "double").alias("struct_return"))


@register("t6_name_positional_args", "T", oracle=f"""
WITH {_INV_SQL},
ex AS (SELECT seq, name, vals, names, unnest(generate_series(1, least(len(vals), len(names)))) AS i FROM pj)
SELECT seq, name, CASE WHEN names[i] = '' THEN '_' || CAST(i AS VARCHAR) ELSE names[i] END AS param,
       vals[i] AS value FROM ex""")
def t6(spark, d):
    named, _ = T.name_positional_args(views.positional_trace(spark, d), _inventory(spark, d))
    return named.select("seq", "name", F.explode("args").alias("param", "value"))


@register("t6_positional_rejects", "T", oracle=f"""
WITH {_INV_SQL},
ex AS (SELECT seq, name, vals, unnest(generate_series(len(names) + 1, len(vals))) AS i FROM pj)
SELECT seq, name, CAST(i AS INTEGER) AS ordinal, vals[i] AS value FROM ex""")
def t6b(spark, d):
    _, extra = T.name_positional_args(views.positional_trace(spark, d), _inventory(spark, d))
    return extra.select("seq", "name", F.col("ordinal").cast("int").alias("ordinal"), "value")


@register("t7_calls_per_function", "T", oracle=f"""
WITH {_TR} SELECT name, count(*) AS calls FROM trace GROUP BY name""")
def t7(spark, d):
    return T.calls_per_function(views.trace(spark, d))


@register("t8_distinct_arguments", "T", oracle=f"""
WITH {_TR},
kv AS (SELECT name, 'user' AS param, a_user AS value FROM trace
       UNION ALL SELECT name, 'props', a_props FROM trace)
SELECT name, param, count(DISTINCT value) AS distinct_values, count(*) AS calls FROM kv GROUP BY ALL""")
def t8(spark, d):
    return T.distinct_arguments(views.trace(spark, d))


@register("t8_distinct_sketches", "T", oracle=f"""
WITH {_TR},
kv AS (SELECT name, 'user' AS param, a_user AS value FROM trace
       UNION ALL SELECT name, 'props', a_props FROM trace)
SELECT name, param, count(DISTINCT value) AS distinct_values, true AS within FROM kv GROUP BY ALL""")
def t8_sketches(spark, d):
    """T8, approximate form: a sketch per day, written, merged over all days;
    the exact count and whether the merged estimate lies within its bound."""
    dated = views.trace_raw(spark, d, day=True)
    good, _ = T.parse_records(dated)
    path = shared_path(spark, "argument-sketches")
    T.sketch_arguments(good, "day").write.partitionBy("day").parquet(path)
    merged = T.merge_sketches(spark.read.parquet(path))
    exact = T.distinct_arguments(good).select("name", "param", "distinct_values")
    low, high = T.sketch_bounds(F.col("distinct_values"))
    return exact.join(merged, ["name", "param"]).select(
        "name", "param", "distinct_values", F.col("estimate").between(low, high).alias("within"))


# ---------------------------------------------------------------- logs on disk
_RUNS_SQL = f"""{_TR},
logged AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS place FROM trace),
runs AS (SELECT file, place AS seq, name,
                sum(CASE WHEN name = 'set_program_name' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY file ORDER BY place ROWS UNBOUNDED PRECEDING) AS run
         FROM logged)"""


def _logs(spark, d, pieces):
    """The event trace as ten logs cut into pieces by size, the earlier half of
    the events first, in the shared folder."""
    base = shared_path(spark, "trace")
    raw = views.trace_raw(spark, d, terminator=False)
    half = raw.agg(F.percentile_approx("seq", 0.5).alias("m")).first()["m"]
    write_logs(raw.where(F.col("seq") <= half), f"{base}/logs", pieces=pieces)
    write_logs(raw.where(F.col("seq") > half), f"{base}/logs", pieces=pieces, generation=1)
    return base


def _read_names(spark, d):
    """(file, seq, name) of the logs on disk, seq being the place in the log."""
    names = T.record_names(read_trace(spark, f"{_logs(spark, d, 16)}/logs"))
    return names.select(F.col("log").cast("bigint").alias("file"), "seq", "name")


@register("t1_read_trace", "T", oracle=f"""
WITH {_TR}
SELECT file, row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS seq, name, a_user AS user, a_props AS props, ret
FROM trace""")
def t1(spark, d):
    """T2 -> files -> T1 -> T11: records written as logs of at least 20 pieces
    each, read back with the multi-character separator, put in order, parsed."""
    good, _ = T.parse_records(read_trace(spark, f"{_logs(spark, d, 150)}/logs"))
    return good.select(F.col("log").cast("bigint").alias("file"), "seq", "name", F.col("args")["user"].alias("user"),
                       F.col("args")["props"].alias("props"), F.get("ret", 0).alias("ret"))


@register("t9_split_runs", "T", oracle=f"""
WITH {_RUNS_SQL} SELECT file, seq, name, CAST(run AS BIGINT) AS run FROM runs""")
def t9(spark, d):
    return T.split_runs(_read_names(spark, d))


@register("t10_crashed_runs", "T", oracle=f"""
WITH {_RUNS_SQL}
SELECT file, CAST(run AS BIGINT) AS run, count(*) AS records, bool_or(name = 'main') AS has_main,
       min(seq) AS first_seq
FROM runs GROUP BY file, run HAVING NOT bool_or(name = 'main')""")
def t10(spark, d):
    return T.crashed_runs(T.split_runs(_read_names(spark, d)))


@register("t2_write_trace", "T", oracle=f"""
WITH {_TR}
SELECT name, a_user AS user, a_props AS props, ret, count(*) AS records FROM trace GROUP BY ALL""")
def t2(spark, d):
    """T11 -> T2 -> files -> T1 -> T11: parsed rows rendered, written and read back."""
    path = shared_path(spark, "trace-again")
    t = views.trace(spark, d)
    write_trace(t.select("name", F.map_keys("args").alias("keys"), F.map_values("args").alias("values"), "ret"), path)
    good, _ = T.parse_records(read_records(spark, path))
    return good.groupBy("name", F.col("args")["user"].alias("user"), F.col("args")["props"].alias("props"),
                        F.get("ret", 0).alias("ret")).agg(F.count(F.lit(1)).alias("records"))


# ---------------------------------------------------------------- streaming
@register("t12_stream_call_counts", "T", oracle=f"""
WITH {_TR} SELECT name, count(*) AS calls FROM trace GROUP BY name""")
def t12(spark, d):
    base = _logs(spark, d, 16)
    counts = S.stream_call_counts(S.trace_stream(spark, f"{base}/logs", max_files_per_trigger=32))
    S.run_available_now(counts, f"{base}/ckpt", "update", "foreach_parquet", path=f"{base}/out")
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("name").agg(F.max("calls").alias("calls"))


@register("t13_stream_run_state", "T", oracle=f"""
WITH {_RUNS_SQL}
SELECT file, CAST(run AS BIGINT) AS run, count(*) AS records, bool_or(name = 'main') AS has_main,
       CAST(run AS BIGINT) < max(max(CAST(run AS BIGINT))) OVER (PARTITION BY file) AS closed
FROM runs GROUP BY file, run""")
def t13(spark, d):
    base = _logs(spark, d, 16)
    runs = S.follow_runs(spark, f"{base}/logs", base, max_files_per_trigger=32)
    return runs.select(F.col("log").cast("bigint").alias("file"), "run", "records", "has_main", "closed")
