"""X area queries: translation batches, verdicts, prompts, model calls."""

from pyspark.sql import functions as F

from corvid.operators import translate as X
from corvid.plans import views
from corvid.plans.catalog import register
from corvid.sources.tables import table

_A, _TS = views.ATTEMPTS_SQL, views.TESTS_SQL

@register("x4_resolve_source_path", "X", oracle=f"""
WITH {views.COMMANDS_SQL}
SELECT id, CASE WHEN starts_with(file, '/') THEN file ELSE rtrim(directory, '/') || '/' || file END AS path
FROM commands""")
def x4(spark, d):
    c = views.commands(spark, d)
    return c.select("id", X.resolve_source_path(F.col("directory"), F.col("file")).alias("path"))


@register("x5_include_dirs", "X", oracle=f"""
WITH {views.COMMANDS_SQL},
ex AS (SELECT id, arguments, unnest(generate_series(1, len(arguments))) AS i FROM commands)
SELECT id, CAST(i - 1 AS INTEGER) AS arg_pos, ltrim(substring(arguments[i], 3)) AS include_dir
FROM ex WHERE starts_with(arguments[i], '-I')""")
def x5(spark, d):
    return X.include_dirs(views.commands(spark, d).select("id", "arguments"))


@register("x6_classify_failure", "X", oracle=f"""
WITH {views.MESSAGES_SQL}
SELECT okey, attempt,
       CASE WHEN category = 'Test Failure' THEN 'test failure' WHEN contains(message, 'Timeout') THEN 'timeout'
            WHEN contains(message, 'rust-lld: error:') THEN 'linker' WHEN message IS NOT NULL THEN 'compile error' END AS kind
FROM messages""")
def x6(spark, d):
    m = views.messages(spark, d)
    return m.select("okey", "attempt", X.classify_failure(F.col("message"), F.col("category")).alias("kind"))


# Model registry: configuration, a handful of rows.
REGISTRY = [("small", "provider-a", "a-small-1"), ("large", "provider-a", "a-large-1"),
            ("fast", "provider-b", "b-fast-1")]
SHORT_NAMES = ["small", "large", "fast", "tiny"]
_REG_SQL = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in REGISTRY)
_REQ_SQL = f"""requests AS (
  SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'large' WHEN 2 THEN 'fast'
                             ELSE 'tiny' END AS model
  FROM conversations),
registry(model, provider, model_id) AS (VALUES {_REG_SQL})"""


def _requests(spark, d):
    names = F.array(*[F.lit(x) for x in SHORT_NAMES])
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.element_at(names, (F.col("conv_id") % 4 + 1).cast("int")).alias("model"))


def _registry(spark):
    return spark.createDataFrame(REGISTRY, "model string, provider string, model_id string")


@register("x7_lookup_models", "X", oracle=f"""
WITH {_REQ_SQL}
SELECT conv_id, turn, model, provider, model_id FROM requests JOIN registry USING (model)""")
def x7(spark, d):
    ok, _ = X.lookup_models(_requests(spark, d), _registry(spark))
    return ok


@register("x7_model_rejects", "X", oracle=f"""
WITH {_REQ_SQL}
SELECT conv_id, turn, model FROM requests WHERE model NOT IN (SELECT model FROM registry)""")
def x7b(spark, d):
    _, bad = X.lookup_models(_requests(spark, d), _registry(spark))
    return bad


@register("x8_apply_blocklist", "X", oracle=f"""
WITH {views.FUNCTIONS_SQL}, {_A},
blocklist AS (SELECT CASE WHEN okey % 100 = 0 THEN 'main_0' ELSE func END AS name FROM attempts WHERE success)
SELECT c_custkey, name FROM functions
WHERE name NOT IN (SELECT CASE WHEN name = 'main_0' THEN 'main' ELSE name END FROM blocklist)""")
def x8(spark, d):
    a = views.attempts(spark, d).where("success")
    bl = a.select(F.when(F.col("okey") % 100 == 0, F.lit("main_0")).otherwise(F.col("func")).alias("name"))
    return X.apply_blocklist(views.functions(spark, d).select("c_custkey", "name"), bl)


_SPAN_SQL = views.SRC_LINES_SQL


@register("x9_join_spans_to_source", "X", oracle=f"""
WITH {_SPAN_SQL}
SELECT s.span_id, count(*) AS n_lines, CAST(sum(length(l.line)) AS BIGINT) AS chars
FROM spans s JOIN src_lines l ON s.file = l.file AND l.line_no BETWEEN s.start_line AND s.end_line
GROUP BY s.span_id""")
def x9(spark, d):
    j = X.join_spans_to_files(views.spans(spark, d), views.src_files(spark, d))
    return j.select("span_id", F.size("part").cast("bigint").alias("n_lines"),
                    F.length(F.array_join("part", "")).cast("bigint").alias("chars"))


_PIECES_SQL = f"""{_SPAN_SQL},
pieces AS (
  SELECT s.span_id, l.line_no,
         CASE WHEN l.line_no = s.start_line AND l.line_no = s.end_line
                THEN substring(l.line, s.start_col, greatest(s.end_col - s.start_col + 1, 0))
              WHEN l.line_no = s.start_line THEN substring(l.line, s.start_col)
              WHEN l.line_no = s.end_line THEN substring(l.line, 1, s.end_col)
              ELSE l.line END AS t
  FROM spans s JOIN src_lines l ON s.file = l.file AND l.line_no BETWEEN s.start_line AND s.end_line),
extracted AS (SELECT span_id, string_agg(t, chr(10) ORDER BY line_no, t) AS text FROM pieces GROUP BY span_id)"""


@register("x18_extract_span", "X", oracle=f"""
WITH {_PIECES_SQL} SELECT span_id, text FROM extracted""")
def x18(spark, d):
    return X.extract_span_in_files(views.spans(spark, d), views.src_files(spark, d))


# Three spans for each file with a span; the last two begin or end on one line.
_SPANS19_SQL = f"""{_SPAN_SQL},
spans3 AS (
  SELECT file, start_line, start_col, end_line, end_col FROM spans
  UNION ALL SELECT file, end_line + 2, start_col + 3, end_line + 4, end_col FROM spans
  UNION ALL SELECT file, end_line + 4, end_col + 5, end_line + 4, end_col + 9 FROM spans)"""


def _spans19(spark, d):
    s = views.spans(spark, d)
    end, col = F.col("end_line"), F.col("end_col")
    names = ("start_line", "start_col", "end_line", "end_col")
    three = [[F.col(n) for n in names], [end + 2, F.col("start_col") + 3, end + 4, col], [end + 4, col + 5, end + 4, col + 9]]
    return s.select("file", F.inline(F.array(*[F.struct(*[c.alias(n) for c, n in zip(x, names)]) for x in three])))


@register("x19_comment_out_span", "X", oracle=f"""
WITH {_SPANS19_SQL},
l AS (SELECT file, line_no, regexp_replace(line, '\\s+$', '') AS line FROM src_lines),
f AS (
  SELECT l.file, l.line_no, l.line, coalesce(bool_or(s.start_line < line_no AND line_no <= s.end_line), FALSE) AS inside,
         coalesce(bool_or(s.start_line <= line_no AND line_no < s.end_line), FALSE) AS goes_on,
         min(CASE WHEN s.start_line = line_no THEN s.start_col END) AS c1,
         max(CASE WHEN s.end_line = line_no THEN s.end_col END) AS c2
  FROM l LEFT JOIN spans3 s ON l.file = s.file GROUP BY ALL),
h AS (SELECT *, CASE WHEN c2 IS NOT NULL AND NOT goes_on THEN substring(line, 1, c2) ELSE line END AS head,
             CASE WHEN c2 IS NOT NULL AND NOT goes_on THEN substring(line, c2 + 1) ELSE '' END AS tail FROM f)
SELECT file, line_no, 0 AS part,
       CASE WHEN inside THEN '// ' || head
            WHEN c1 IS NOT NULL THEN substring(head, 1, c1 - 1) || '// ' || substring(head, c1) ELSE head END AS line
FROM h
UNION ALL SELECT file, line_no, 1, tail FROM h WHERE tail <> ''""")
def x19(spark, d):
    return X.comment_out_span_in_files(_spans19(spark, d), views.src_files(spark, d))


# Prompt texts are our own.
SYSTEM_PROMPT = "You translate C functions into safe Rust. Answer with FUNC, WRAPPER and optional IMPORTS sections."
USER_TEMPLATE = "Translate the function {name} below.\n{code}\nKeep its name and behaviour."


@register("x20_render_prompt", "X", oracle=f"""
WITH {_PIECES_SQL},
conv AS (
  SELECT span_id, 1 AS turn, 'system' AS role, '{SYSTEM_PROMPT}' AS content FROM extracted
  UNION ALL
  SELECT span_id, 2, 'user',
         replace(replace('{USER_TEMPLATE.replace(chr(10), "' || chr(10) || '")}', '{{name}}', 'fn_' || CAST(span_id AS VARCHAR)),
                 '{{code}}', text)
  FROM extracted)
SELECT span_id, CAST(turn AS INTEGER) AS turn, role, content FROM conv""")
def x20(spark, d):
    ex = X.extract_span_in_files(views.spans(spark, d), views.src_files(spark, d))
    conv = X.render_prompt(SYSTEM_PROMPT, USER_TEMPLATE,
                           {"name": F.concat(F.lit("fn_"), F.col("span_id").cast("string")), "code": F.col("text")})
    return ex.select("span_id", F.posexplode(conv).alias("pos", "m")).select(
        "span_id", (F.col("pos") + 1).cast("int").alias("turn"), F.col("m.role").alias("role"),
        F.col("m.content").alias("content"))


# Repair texts are our own.
REPAIRS = {"Compile Error": "The translation did not compile:\n{message}\nFix it.",
           "Test Failure": "The translation compiled but tests failed:\n{message}\nFix it."}


@register("x21_repair_prompt", "X", oracle=f"""
WITH {_A}
SELECT func, attempt, CAST(3 AS INTEGER) AS n_messages,
       CASE category
         WHEN 'Compile Error' THEN 'The translation did not compile:' || chr(10) || 'attempt ' || CAST(attempt AS VARCHAR) || chr(10) || 'Fix it.'
         WHEN 'Test Failure' THEN 'The translation compiled but tests failed:' || chr(10) || 'attempt ' || CAST(attempt AS VARCHAR) || chr(10) || 'Fix it.'
       END AS content
FROM attempts WHERE NOT success""")
def x21(spark, d):
    a = views.attempts(spark, d).where(~F.col("success"))
    base = F.array(F.struct(F.lit("user").alias("role"), F.col("func").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.lit("<FUNC>\n</FUNC>").alias("content")))
    msg = X.repair_prompt(F.col("category"), F.concat(F.lit("attempt "), F.col("attempt").cast("string")), REPAIRS)
    conv = X.extend_conversation(base, "user", msg)
    return a.select("func", "attempt", F.size(conv).alias("n_messages"),
                    F.element_at(conv, -1)["content"].alias("content"))


@register("x22_provider_messages", "X", oracle="""
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'model' ELSE role END AS role, text
FROM conversations WHERE role <> 'system'""")
def x22(spark, d):
    return X.provider_messages(table(spark, d, "conversations"), "contents")


_RESP_SQL = """responses AS (
  SELECT conv_id, turn,
         CASE WHEN turn % 3 = 0 THEN '' ELSE '<IMPORTS>' || chr(10) || 'use std::io;' || chr(10) || '</IMPORTS>' || chr(10) END
         || CASE WHEN turn % 4 = 1 THEN '' ELSE '<FUNC>' || chr(10) || '```rust' || chr(10) || text || chr(10) || '```' || chr(10)
                     || CASE WHEN conv_id % 5 = 2 THEN '' ELSE '</FUNC>' || chr(10) END END
         || '<WRAPPER>' || chr(10) || '  fn wrapper_' || CAST(conv_id AS VARCHAR) || '() {}  ' || chr(10) || '</WRAPPER>' AS response
  FROM conversations WHERE role = 'assistant')"""


def _responses(spark, d):
    c = table(spark, d, "conversations").where(F.col("role") == "assistant")
    nl = F.lit("\n")
    imports = F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.lit("<IMPORTS>\nuse std::io;\n</IMPORTS>\n"))
    func = F.when(F.col("turn") % 4 == 1, F.lit("")).otherwise(
        F.concat(F.lit("<FUNC>\n```rust\n"), F.col("text"), nl, F.lit("```\n"),
                 F.when(F.col("conv_id") % 5 == 2, "").otherwise("</FUNC>\n")))
    wrapper = F.concat(F.lit("<WRAPPER>\n  fn wrapper_"), F.col("conv_id").cast("string"), F.lit("() {}  \n</WRAPPER>"))
    return c.select("conv_id", "turn", F.concat(imports, func, wrapper).alias("response"))


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _tag_sql(tag: str) -> str:
    inner = f"coalesce(string_split(string_split(response, '<{tag}>' || chr(10))[2], '</{tag}>')[1], '')"
    return _strip_sql(f"replace(replace({inner}, '```rust', ''), '```', '')")


@register("x23_extract_tags", "X", oracle=f"""
WITH {_RESP_SQL}
SELECT conv_id, turn, {_tag_sql('FUNC')} AS func, {_tag_sql('WRAPPER')} AS wrapper,
       {_tag_sql('IMPORTS')} AS imports,
       NOT (contains(response, '<FUNC>' || chr(10)) AND contains(response, '<WRAPPER>' || chr(10)))
         AS retry
FROM responses""")
def x23(spark, d):
    r = _responses(spark, d)
    t = X.extract_tags(F.col("response"))
    return r.select("conv_id", "turn", t.func.alias("func"), t.wrapper.alias("wrapper"),
                    t.imports.alias("imports"), t.retry.alias("retry"))


@register("x10_suite_passed", "X", oracle=f"""
WITH {_A}, {_TS},
per AS (SELECT func, attempt, bool_and(status = 'passed') AS ok, count(*) AS n FROM tests GROUP BY ALL)
SELECT a.func, a.attempt, coalesce(p.ok, TRUE) AS passed, coalesce(p.n, 0) AS n_tests
FROM (SELECT DISTINCT func, attempt FROM attempts) a LEFT JOIN per p USING (func, attempt)""")
def x10(spark, d):
    return X.suite_passed(views.attempts(spark, d), views.tests(spark, d))


@register("x11_first_failure", "X", oracle=f"""
WITH {_TS},
r AS (SELECT *, row_number() OVER (PARTITION BY func, attempt ORDER BY ordinal, test, error) AS rn
      FROM tests WHERE status = 'failed')
SELECT func, attempt, ordinal, test, error FROM r WHERE rn = 1""")
def x11(spark, d):
    return X.first_failure(views.tests(spark, d))


@register("x14_stop_on_failure", "X", oracle=f"""
WITH {_TS},
ff AS (SELECT func, attempt, min(ordinal) AS f FROM tests WHERE status = 'failed' GROUP BY ALL)
SELECT t.func, t.attempt, t.ordinal, t.test, t.status FROM tests t LEFT JOIN ff USING (func, attempt)
WHERE ff.f IS NULL OR t.ordinal <= ff.f""")
def x14(spark, d):
    return X.stop_on_failure(views.tests(spark, d)).select("func", "attempt", "ordinal", "test", "status")


_OUT_SQL = f"""{_A},
outcomes AS (
  SELECT func, okey,
         CASE WHEN min(CASE WHEN success THEN attempt END) IS NOT NULL THEN 'Success'
              ELSE arg_max(category, attempt) END AS result,
         coalesce(min(CASE WHEN success THEN attempt END), max(attempt)) AS attempts_used
  FROM attempts GROUP BY func, okey)"""


@register("x13_attempt_outcomes", "X", oracle=f"""
WITH {_OUT_SQL} SELECT func, result, attempts_used FROM outcomes""")
def x13(spark, d):
    return X.attempt_outcomes(views.attempts(spark, d))


@register("x12_result_summary", "X", oracle=f"""
WITH {_OUT_SQL}
SELECT CASE okey % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' ELSE 'model-c' END AS model,
       result, count(*) AS functions
FROM outcomes GROUP BY ALL""")
def x12(spark, d):
    a = views.attempts(spark, d)
    out = X.attempt_outcomes(a).join(a.select("func", "okey").distinct(), "func")
    models = F.array(*[F.lit(m) for m in views.MODELS])
    # one log per (model, batch of 100 functions): bounded result arrays
    logs = (out.withColumn("model", F.element_at(models, (F.col("okey") % 3 + 1).cast("int")))
            .groupBy("model", F.floor(F.col("okey") / 100).alias("batch"))
            .agg(F.collect_list(F.struct(F.col("func").alias("function"), F.col("result").alias("results")))
                 .alias("results")))
    return X.result_summary(logs)


@register("x16_executable_targets", "X", oracle=f"""
WITH {views.DB_LINES_SQL},
t AS (SELECT project, split_part(line, ':', 1) AS target FROM db_lines
      WHERE regexp_matches(line, '^[a-zA-Z0-9_-]+:([^=]|$)')),
ph AS (SELECT project, unnest(regexp_extract_all(split_part(line, ':', 2), '\\S+')) AS target FROM db_lines WHERE starts_with(line, '.PHONY:'))
SELECT DISTINCT project, target FROM t
WHERE target <> 'Makefile' AND NOT EXISTS (SELECT 1 FROM ph WHERE ph.project = t.project AND ph.target = t.target)""")
def x16(spark, d):
    real, _ = X.executable_targets(views.db_lines(spark, d))
    return real


@register("x16_target_report", "X", oracle=f"""
WITH {views.DB_LINES_SQL},
t AS (SELECT project, split_part(line, ':', 1) AS target FROM db_lines
      WHERE regexp_matches(line, '^[a-zA-Z0-9_-]+:([^=]|$)')),
ph AS (SELECT project, unnest(regexp_extract_all(split_part(line, ':', 2), '\\S+')) AS target FROM db_lines WHERE starts_with(line, '.PHONY:')),
r AS (SELECT DISTINCT project, target FROM t
      WHERE target <> 'Makefile' AND NOT EXISTS (SELECT 1 FROM ph WHERE ph.project = t.project AND ph.target = t.target))
SELECT p.project, count(r.target) AS n_targets FROM (SELECT DISTINCT project FROM db_lines) p
LEFT JOIN r ON p.project = r.project GROUP BY p.project HAVING count(r.target) <> 1""")
def x16b(spark, d):
    _, report = X.executable_targets(views.db_lines(spark, d))
    return report


@register("x17_compare_golden", "X", oracle="""
WITH expected AS (SELECT conv_id, turn, role, text FROM conversations),
actual AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN upper(role) ELSE role END AS role, text FROM conversations)
SELECT *, 'expected_only' AS side FROM (SELECT * FROM expected EXCEPT ALL SELECT * FROM actual)
UNION ALL
SELECT *, 'actual_only' FROM (SELECT * FROM actual EXCEPT ALL SELECT * FROM expected)""")
def x17(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    actual = c.withColumn("role", F.when(F.col("turn") == 0, F.upper("role")).otherwise(F.col("role")))
    return X.compare_golden(actual, c)
