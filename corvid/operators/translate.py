"""X area: code-translation batches as DataFrame jobs.

Spans of source text, prompts and conversations, tag extraction, verdict classification, attempt
sequences and test-suite outcomes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.code import unrename_entry
from corvid.functions.text import between_tags, has_tag, strip_ws
from corvid.plans.ordering import small_join

# Failure markers and categories of a verdict.
TIMEOUT_MARK = "Timeout"
LINKER_MARK = "rust-lld: error:"
COMPILE_ERROR = "Compile Error"
TEST_FAILURE = "Test Failure"
SUCCESS = "Success"
RETURN_SLOT = "<return_val>"
INCLUDE_FLAG = "-I"
MAKE_TARGET_PATTERN = r"^[a-zA-Z0-9_-]+:([^=]|$)"
PHONY = ".PHONY"
MAKEFILE = "Makefile"
CODE_FENCES = ["```rust", "```"]


# ------------------------------------------------------------ compile commands
def resolve_source_path(directory: Column, file: Column) -> Column:
    """Absolute file names are kept, relative ones are joined to the directory."""
    joined = F.concat(F.regexp_replace(directory, "/+$", ""), F.lit("/"), file)
    return F.when(file.startswith("/"), file).otherwise(joined)


def include_dirs(commands: DataFrame, distinct: bool = False) -> DataFrame:
    """``-I`` arguments with the flag removed and left-trimmed; duplicates kept unless asked."""
    keep = [c for c in commands.columns if c != "arguments"]
    args = commands.select(*keep, F.posexplode("arguments").alias("arg_pos", "arg"))
    inc = (args.where(F.col("arg").startswith(INCLUDE_FLAG))
           .withColumn("include_dir", F.ltrim(F.expr("substring(arg, 3)")))
           .drop("arg"))
    return inc.dropDuplicates([*keep, "include_dir"]).drop("arg_pos") if distinct else inc


def classify_failure(message: Column, category: Column | None = None) -> Column:
    """A test failure by its category; else the first match wins: timeout,
    linker error, compile error. No message gives NULL."""
    kind = (F.when(message.contains(TIMEOUT_MARK), "timeout")
            .when(message.contains(LINKER_MARK), "linker")
            .when(message.isNotNull(), "compile error"))
    return kind if category is None else F.when(category == TEST_FAILURE, "test failure").otherwise(kind)


# ------------------------------------------------------------ models
def lookup_models(requests: DataFrame, registry: DataFrame, key: str = "model") -> tuple[DataFrame, DataFrame]:
    """Short model name -> provider and model id; unknown names are rejected.

    The planner broadcasts a registry of a few rows by its size; the rejects
    are the anti join of the same key.
    """
    ok = requests.join(registry, key, "inner")
    rejects = requests.join(registry, key, "left_anti")
    return ok, rejects


def apply_blocklist(functions: DataFrame, blocklist: DataFrame, name: str = "name") -> DataFrame:
    """Drop functions already translated; ``main_0`` in the list stands for ``main``."""
    bl = blocklist.select(unrename_entry(F.col(name)).alias(name)).distinct()
    return functions.join(bl, name, "left_anti")


# ------------------------------------------------------------ spans
def join_spans_to_source(spans: DataFrame, lines: DataFrame, file: str = "file") -> DataFrame:
    """Each span with the lines of its file inside [start_line, end_line].

    Equi join on the file (hash key) plus a range filter on the line number,
    never a nested loop.
    """
    j = spans.join(lines, file)
    return j.where(F.col("line_no").between(F.col("start_line"), F.col("end_line")))


def _span_piece() -> Column:
    ln, s, e = F.col("line_no"), F.col("start_line"), F.col("end_line")
    sc, ec, line = F.col("start_col"), F.col("end_col"), F.col("line")
    return (F.when((ln == s) & (ln == e), F.substring(line, sc, F.greatest(ec - sc + 1, F.lit(0))))
            .when(ln == s, F.expr("substring(line, start_col)"))
            .when(ln == e, F.substring(line, F.lit(1), ec))
            .otherwise(line))


def extract_span(spans: DataFrame, lines: DataFrame, key: Sequence[str] = ("span_id",),
                 file: str = "file") -> DataFrame:
    """Text from (start_line, start_col) to (end_line, end_col), inclusive.

    A single-line span is one substring (the reference duplicates it). The
    pieces of one span are gathered with ``collect_list`` of (line_no, text)
    and sorted; a group is one span, bounded by the function's length.
    """
    j = join_spans_to_source(spans, lines, file)
    pieces = j.select(*key, F.struct("line_no", _span_piece().alias("t")).alias("p"))
    return (pieces.groupBy(*key)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "\n").alias("text")))


# Where a file is one row, (file, lines ARRAY<STRING>), spans meet it there: a
# span takes its slice of the array, and no line is a row of a shuffle. Spans
# are narrow; they are broadcast while they are few and joined as the planner
# chooses beyond.
def join_spans_to_files(spans: DataFrame, files: DataFrame, file: str = "file", lines: str = "lines") -> DataFrame:
    """X9 on file rows: each span that begins within its file, with ``part``,
    the array of its lines."""
    j = small_join(files, spans, file, spans.count())
    part = F.slice(F.col(lines), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    inside = (F.col("start_line") <= F.size(lines)) & (F.col("start_line") <= F.col("end_line"))
    return j.where(inside).withColumn("part", part).drop(lines)


def extract_span_in_files(spans: DataFrame, files: DataFrame, key: Sequence[str] = ("span_id",), file: str = "file",
                          lines: str = "lines") -> DataFrame:
    """X18 on file rows: the text of each span, cut out of its slice."""
    s, e, sc, ec = (F.col(c) for c in ("start_line", "end_line", "start_col", "end_col"))

    def piece(line: Column, i: Column) -> Column:
        from_start = F.substr(line, sc.cast("int"))
        only = F.substr(line, sc.cast("int"), F.greatest(ec - sc + 1, F.lit(0)).cast("int"))
        return (F.when((i == 0) & (s == e), only).when(i == 0, from_start)
                .when(s + i == e, F.substr(line, F.lit(1), ec.cast("int"))).otherwise(line))

    j = join_spans_to_files(spans, files, file, lines)
    return j.select(*key, F.array_join(F.transform("part", piece), "\n").alias("text"))


def comment_out_span_in_files(spans: DataFrame, files: DataFrame, file: str = "file", lines: str = "lines") -> DataFrame:
    """X19 on file rows: spans are joined to files, then lines are exploded."""
    per_file = _spans_by_file(spans, file)
    j = small_join(files, per_file.withColumnRenamed("_f", file), file, spans.count(), "left")
    rows = j.select(file, "_spans", F.posexplode(lines).alias("_at", "line"))
    return _comment_out(rows.withColumn("line_no", (F.col("_at") + 1).cast("bigint")).drop("_at"), file)


_SPAN_ARRAY = "array<struct<start_line:bigint,start_col:bigint,end_line:bigint,end_col:bigint>>"


def _spans_by_file(spans: DataFrame, file: str) -> DataFrame:
    s = F.struct("start_line", "start_col", "end_line", "end_col")
    return (spans.where(F.col("end_line") >= F.col("start_line"))
            .groupBy(F.col(file).alias("_f")).agg(F.collect_list(s).cast(_SPAN_ARRAY).alias("_spans")))


def comment_out_span(spans: DataFrame, lines: DataFrame, file: str = "file") -> DataFrame:
    """``// `` goes in at start_col of a span's first line and before its
    other lines; text after end_col on the last line moves to a new line below.
    Trailing white space of every line goes first.

    The spans of a file are one small array that each of its lines meets once,
    so a file may have several. Text between two spans of one line is
    commented out with them. Output: ``(file, line_no, part, line)`` for all
    lines, where ``part`` 1 is the moved tail.
    """
    per_file = _spans_by_file(spans, file)
    return _comment_out(lines.join(per_file, F.col(file) == F.col("_f"), "left"), file)


def _comment_out(rows: DataFrame, file: str) -> DataFrame:
    """X19 on (file, line_no, line, _spans) rows."""
    j = rows.withColumns({"_line": F.regexp_replace("line", r"\s+$", ""), "_spans": F.coalesce("_spans", F.array().cast(_SPAN_ARRAY))})
    j = j.withColumns({
        "_inside": F.expr("exists(_spans, s -> s.start_line < line_no AND line_no <= s.end_line)"),
        "_goes_on": F.expr("exists(_spans, s -> s.start_line <= line_no AND line_no < s.end_line)"),
        "_from": F.expr("array_min(transform(filter(_spans, s -> s.start_line = line_no), s -> s.start_col))"),
        "_to": F.expr("array_max(transform(filter(_spans, s -> s.end_line = line_no), s -> s.end_col))")})
    cut = F.col("_to").isNotNull() & ~F.col("_goes_on")
    j = j.withColumns({"_head": F.when(cut, F.expr("substring(_line, 1, int(_to))")).otherwise(F.col("_line")),
                       "_tail": F.when(cut, F.expr("substring(_line, int(_to) + 1)")).otherwise(F.lit(""))})
    head = (F.when(F.col("_inside"), F.concat(F.lit("// "), F.col("_head")))
            .when(F.col("_from").isNotNull(), F.expr("concat(substring(_head, 1, int(_from) - 1), '// ', substring(_head, int(_from)))"))
            .otherwise(F.col("_head")))
    parts = F.array(F.struct(F.lit(0).alias("part"), head.alias("line")), F.struct(F.lit(1).alias("part"), F.col("_tail").alias("line")))
    return j.select(file, "line_no", F.inline(parts)).where((F.col("part") == 0) | (F.col("line") != ""))


# ------------------------------------------------------------ prompts and conversations
def render_template(template: str, values: Mapping[str, Column]) -> Column:
    """Replace ``{name}`` placeholders of a text template with column values."""
    out: Column = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def render_prompt(system: str, user_template: str, values: Mapping[str, Column]) -> Column:
    """A two-message conversation ``ARRAY<STRUCT<role, content>>``."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), render_template(user_template, values).alias("content")))


def extend_conversation(conv: Column, role: str | Column, text: Column) -> Column:
    """Append one message to a conversation array."""
    r = F.lit(role) if isinstance(role, str) else role
    return F.concat(conv, F.array(F.struct(r.alias("role"), text.alias("content"))))


def repair_prompt(category: Column, message: Column, templates: Mapping[str, str]) -> Column:
    """Repair text by failure category; an unknown category gives NULL (route to rejects)."""
    out = None
    for cat, tmpl in templates.items():
        txt = F.replace(F.lit(tmpl), F.lit("{message}"), F.coalesce(message, F.lit("")))
        out = F.when(category == cat, txt) if out is None else out.when(category == cat, txt)
    return out


def provider_messages(messages: DataFrame, style: str, role: str = "role") -> DataFrame:
    """Per-provider message list. All styles drop ``system`` messages;
    the ``contents`` style calls the assistant ``model``."""
    m = messages.where(F.col(role) != "system")
    if style == "contents":
        m = m.withColumn(role, F.when(F.col(role) == "assistant", F.lit("model")).otherwise(F.col(role)))
    elif style != "messages":
        raise ValueError(f"unknown provider style {style!r}")
    return m


def extract_tags(response: Column) -> Column:
    """struct(func, wrapper, imports, retry) out of a model answer.

    FUNC and WRAPPER must be opened (else ``retry``); IMPORTS defaults to ''.
    A section that is never closed runs to the end. Code fences are removed
    and the parts stripped.
    """
    def clean(tag: str) -> Column:
        x = between_tags(response, tag)
        for fence in CODE_FENCES:
            x = F.replace(x, F.lit(fence), F.lit(""))
        return strip_ws(x)
    ok = has_tag(response, "FUNC") & has_tag(response, "WRAPPER")
    return F.struct(clean("FUNC").alias("func"), clean("WRAPPER").alias("wrapper"),
                    clean("IMPORTS").alias("imports"), (~ok).alias("retry"))


# ------------------------------------------------------------ verdicts
def suite_passed(suites: DataFrame, tests: DataFrame, key: Sequence[str] = ("func", "attempt"),
                 allow: DataFrame | None = None) -> DataFrame:
    """A suite passes when all its tests passed; an empty suite passes.

    ``allow`` (optional, ``(test)``) restricts the tests that count, i.e.
    the ones that already passed on the baseline.
    """
    t = tests if allow is None else tests.join(allow, "test", "left_semi")
    per = t.groupBy(*key).agg(F.bool_and(F.col("status") == "passed").alias("_all"),
                              F.count(F.lit(1)).alias("n_tests"))
    return (suites.select(*key).distinct().join(per, list(key), "left")
            .select(*key, F.coalesce("_all", F.lit(True)).alias("passed"),
                    F.coalesce("n_tests", F.lit(0).cast("bigint")).alias("n_tests")))


def first_failure(tests: DataFrame, key: Sequence[str] = ("func", "attempt")) -> DataFrame:
    """X11: the first failed test in run order and its error (ties: test name)."""
    f = tests.where(F.col("status") == "failed")
    first = F.min(F.struct("ordinal", "test", "error")).alias("_m")
    return f.groupBy(*key).agg(first).select(*key, F.col("_m.ordinal").alias("ordinal"),
                                             F.col("_m.test").alias("test"), F.col("_m.error").alias("error"))


def stop_on_failure(tests: DataFrame, key: Sequence[str] = ("func", "attempt")) -> DataFrame:
    """Tests up to and including the first failure of each suite.

    The first failing ordinal is a partial aggregate joined back, so no
    window has to hold a whole suite.
    """
    ff = (tests.where(F.col("status") == "failed").groupBy(*key)
          .agg(F.min("ordinal").alias("_ff")))
    j = tests.join(ff, list(key), "left")
    return j.where(F.col("_ff").isNull() | (F.col("ordinal") <= F.col("_ff"))).drop("_ff")


def attempt_outcomes(attempts: DataFrame, num_attempts: int | None = None, key: str = "func") -> DataFrame:
    """Per function, attempts run in order until the first success.

    At most ``max(1, num_attempts)`` validations count (all by default). Result is Success or
    the category of the last attempt used. Pure aggregates (first success =
    min attempt among successes, last = max struct), no window.
    """
    a = attempts if num_attempts is None else attempts.where(F.col("attempt") <= max(1, num_attempts))
    g = a.groupBy(key).agg(
        F.min(F.when(F.col("success"), F.col("attempt"))).alias("_first_ok"),
        F.max(F.struct("attempt", "category")).alias("_last"))
    used = F.coalesce("_first_ok", F.col("_last.attempt"))
    return g.select(key, F.when(F.col("_first_ok").isNotNull(), F.lit(SUCCESS))
                    .otherwise(F.col("_last.category")).alias("result"),
                    used.alias("attempts_used"))


def result_summary(logs: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Functions by outcome per model; logs may carry empty result lists."""
    ex = logs.select(*by, F.explode_outer("results").alias("r"))
    return (ex.groupBy(*by, F.col("r.results").alias("result"))
            .agg(F.count("r").alias("functions")))


# ------------------------------------------------------------ build files
def executable_targets(db_lines: DataFrame, project: str = "project") -> tuple[DataFrame, DataFrame]:
    """Make targets that are neither ``.PHONY`` nor the makefile itself.

    Returns (targets, report) where the report lists projects that do not
    have exactly one target, those without any included.
    """
    line = F.col("line")
    targets = (db_lines.where(line.rlike(MAKE_TARGET_PATTERN))
               .select(project, F.substring_index(line, ":", 1).alias("target")))
    phony = (db_lines.where(line.startswith(PHONY + ":"))
             .select(project, F.explode(F.split(F.trim(F.substring_index(line, ":", -1)), r"\s+")).alias("target"))
             .where(F.col("target") != ""))
    real = (targets.where(F.col("target") != MAKEFILE)
            .join(phony, [project, "target"], "left_anti").distinct())
    counts = real.groupBy(project).agg(F.count(F.lit(1)).alias("_n"))
    report = (db_lines.select(project).distinct().join(counts, project, "left")
              .select(project, F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_targets"))
              .where(F.col("n_targets") != 1))
    return real, report


def compare_golden(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Multiset comparison; rows only on one side, labelled by side, as
    often as they are there more often than on the other. One aggregate over
    both sides, with a count of +1 or -1 a row."""
    names = expected.columns
    both = expected.withColumn("_more", F.lit(1)).unionByName(actual.select(*names).withColumn("_more", F.lit(-1)))
    more = both.groupBy(*names).agg(F.sum("_more").alias("_more")).where("_more <> 0")
    side = F.when(F.col("_more") > 0, "expected_only").otherwise("actual_only").alias("side")
    return more.select(*names, side, F.explode(F.sequence(F.lit(1), F.abs("_more").cast("int"))).alias("_k")).drop("_k")
