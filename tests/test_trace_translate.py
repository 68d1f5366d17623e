"""Unit checks: trace record quirks, file round trip, streaming, spans, tags,
verdicts and the pluggable model call."""

import os
import tempfile

from pyspark.sql import functions as F

from corvid.functions import trace_text as TT
from corvid.operators import trace as T
from corvid.operators import translate as X
from corvid.plans.ordering import blocked_running_sum
from corvid.sources import trace_files

RECORDS = [
    '{ "name": "main", "args": {"argc" : "2", "argv" : "0x7ffd1000"}, "return": ["0"] },\n',
    '{ "name": "show", "args": {"buf" : "say "hi"\nthere", "n" : "(nil)"}, "return": [] },\n',
    '{ "name": "old", "args": ["1", "abc"], "return": ["0x10", ] },\n',
    '{ "name": "odd", "args": {"s" : "<unsupported>", }, "return": ["1"] },\n',
    '"], "return": ["5"] },\n',
    '{ "name": "cut", "args": {"x" : "1"}, "return": ["',
]


def _parse(spark, recs):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(recs)], "seq long, value string")
    return df.select("seq", TT.parse_trace(F.col("value")).alias("p")).orderBy("seq").collect()


def test_parse_trace_quirks(spark):
    p = [r.p for r in _parse(spark, RECORDS)]
    assert p[0].name == "main" and p[0].args == {"argc": "2", "argv": "0x7ffd1000"} and p[0].ret == ["0"]
    assert p[1].args == {"buf": 'say "hi"\nthere', "n": "(nil)"} and p[1].ret == []
    assert not p[2].named and p[2].pos_args == ["1", "abc"] and p[2].ret == ["0x10"]
    assert p[3].ok and p[3].args["s"].startswith("<unsupported>")
    assert not p[4].ok                                  # nameless piece of a multi-return function
    assert p[5].ok and p[5].ret == [""] or not p[5].ok  # truncated record never crashes


def test_render_parse_round_trip(spark):
    df = spark.createDataFrame([("f", ["a", "b"], ['x "q"', "line\nbreak"], ["7"])],
                               "name string, keys array<string>, vals array<string>, ret array<string>")
    r = df.select(TT.parse_trace(TT.render_record(F.col("name"), F.col("ret"), F.col("keys"), F.col("vals")))
                  .alias("p")).first().p
    assert r.name == "f" and r.args == {"a": 'x "q"', "b": "line\nbreak"} and r.ret == ["7"]


def test_render_and_classify_values(spark):
    df = spark.createDataFrame([("int", "-12"), ("double", "2.5"), ("char*", "x" * 150), ("void*", "0"),
                                ("int*", "4096"), ("struct s", "?")], "t string, v string")
    out = [(r.r, r.c) for r in df.select(TT.render_value(F.col("t"), F.col("v")).alias("r"))
           .select("r", TT.classify_value(F.col("r")).alias("c")).collect()]
    assert out == [("-12", "integer"), ("2.500000", "float"), ("x" * 150, "text"), ("(nil)", "null pointer"),
                   ("0x1000", "address"), ("<unsupported>", "unsupported")]


def test_values_that_are_no_numbers_give_null(spark):
    df = spark.createDataFrame([("int", "abc"), ("int*", "zz"), ("double", "?"), ("void*", str((1 << 64) - 1)),
                                ("unsigned long", str((1 << 64) - 1)), ("char*", "x" * 150)], "t string, v string")
    out = [r.r for r in df.select(TT.render_value(F.col("t"), F.col("v"), max_text=100).alias("r")).collect()]
    assert out[:4] == [None, None, None, "0x" + "f" * 16] and out[5] == "x" * 100
    assert out[4] in (str((1 << 64) - 1), "<unsupported>")


def test_repeated_keys_go_to_the_rejects(spark):
    df = spark.createDataFrame([("f", ["a", "a"], ["1", "2"], ["7"]), ("g", ["a"], ["1"], ["7"])],
                               "name string, keys array<string>, vals array<string>, ret array<string>")
    p = df.select(TT.parse_trace(TT.render_record(F.col("name"), F.col("ret"), F.col("keys"), F.col("vals"))).alias("p"))
    assert [(r.p.ok, r.p.args) for r in p.collect()] == [(False, None), (True, {"a": "1"})]


def test_trace_file_round_trip_and_runs(spark):
    d = tempfile.mkdtemp(prefix="trace-", dir="/tmp")
    names = ["set_program_name", "a", "main", "set_program_name", "b", "set_program_name", "c", "main"]
    rows = [(n, ["k"], [f"v{i}\nmore"], [str(i)]) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "name string, keys array<string>, values array<string>, ret array<string>")
    trace_files.write_trace(df.coalesce(1), os.path.join(d, "log"))
    raw = trace_files.read_trace(spark, os.path.join(d, "log"))
    good, bad = T.parse_records(raw)
    assert bad.count() == 0
    tr = good.withColumn("seq", F.col("mid")).withColumn("file", F.lit("f"))
    runs = T.split_runs(tr, block_size=2).orderBy("seq")
    assert [r.run for r in runs.collect()] == [1, 1, 1, 2, 2, 3, 3, 3]
    crashed = T.crashed_runs(T.split_runs(tr)).collect()
    assert [(r.run, r.records) for r in crashed] == [(2, 2)]


def test_blocked_running_sum_matches_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 500).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"),
                                     (F.col("id") % 7 == 0).cast("long").alias("v"))
    a = blocked_running_sum(df, ["k"], "o", F.col("v"), "s", block_size=16)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    b = df.withColumn("s2", F.sum("v").over(w))
    j = a.join(b, ["k", "o"]).where(F.col("s") != F.col("s2"))
    assert j.count() == 0


def test_name_positional_args_and_rejects(spark):
    tr = spark.createDataFrame([("f", ["1", "2", "3"]), ("g", ["9"]), ("h", ["5"])], "name string, pos_args array<string>")
    inv = spark.createDataFrame([("f", ["a", ""], False), ("g", ["p"], True)],
                                "name string, param_names array<string>, struct_return boolean")
    named, extra = T.name_positional_args(tr, inv)
    got = {r.name: r.args for r in named.collect()}
    assert got["f"] == {"a": "1", "_2": "2"} and got["g"] == {"<return_val>": "9"} and got["h"] == {}
    assert {(r.name, r.ordinal, r.value) for r in extra.collect()} == {("f", 3, "3"), ("h", 1, "5")}


def test_streaming_call_counts_and_state(spark):
    from corvid.streaming import trace_stream as S
    d = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    names = ["set_program_name", "x", "main", "set_program_name", "x"]
    rows = [(0, i, TT.RECORD_END.join([]) + f'{{ "name": "{n}", "args": {{}}, "return": []') for i, n in enumerate(names)]
    raw = spark.createDataFrame(rows, "file long, seq long, value string")
    S.write_logs(raw, f"{d}/logs")
    q = S.run_available_now(S.stream_call_counts(S.trace_stream(spark, f"{d}/logs")), f"{d}/c1", "complete",
                            "memory", table="calls_t")
    assert {r.name: r.calls for r in spark.table("calls_t").collect()} == {"set_program_name": 2, "x": 2, "main": 1}
    assert q.lastProgress is not None
    st = {(r.run, r.closed): (r.records, r.has_main) for r in S.follow_runs(spark, f"{d}/logs", d).collect()}
    assert st == {(1, True): (3, True), (2, False): (2, False)}


def _lines(spark):
    text = ["int f(void) {", "  return 1; } int g;", "", "end"]
    return spark.createDataFrame([("a.c", i + 1, t) for i, t in enumerate(text)], "file string, line_no long, line string")


def test_extract_and_comment_spans(spark):
    spans = spark.createDataFrame([(1, "a.c", 1, 5, 1, 10), (2, "a.c", 1, 1, 2, 13), (3, "a.c", 1, 1, 4, 3)],
                                  "span_id int, file string, start_line int, start_col int, end_line int, end_col int")
    ex = {r.span_id: r.text for r in X.extract_span(spans, _lines(spark)).collect()}
    assert ex[1] == "f(void"                             # one substring, not duplicated
    assert ex[2] == "int f(void) {\n  return 1; }"
    assert ex[3] == "int f(void) {\n  return 1; } int g;\n\nend"
    co = X.comment_out_span(spans.where("span_id = 2"), _lines(spark)).orderBy("line_no", "part")
    assert [r.line for r in co.collect()] == ["// int f(void) {", "//   return 1; }", " int g;", "", "end"]
    two = spark.createDataFrame([(1, "a.c", 1, 8, 2, 5), (2, "a.c", 4, 1, 4, 3)], spans.schema)
    src = spark.createDataFrame([("a.c", 1, "int x; int f() { \t"), ("a.c", 2, "  } int g;"), ("a.c", 3, "\t"), ("a.c", 4, "end")],
                                "file string, line_no long, line string")
    co = X.comment_out_span(two, src).orderBy("line_no", "part")
    assert [r.line for r in co.collect()] == ["int x; // int f() {", "//   } i", "nt g;", "", "// end"]


def test_extract_tags(spark):
    resp = ["<IMPORTS>\nuse a;\n</IMPORTS>\n<FUNC>\n```rust\nfn f() {}\n```\n</FUNC>\n<WRAPPER>\nw\n</WRAPPER>",
            "<FUNC>\nfn f() {}\n</FUNC>\n<WRAPPER>\n  w  \n</WRAPPER>",
            "<WRAPPER>\nw\n</WRAPPER>"]
    df = spark.createDataFrame([(r,) for r in resp], "r string")
    t = [x.t for x in df.select(X.extract_tags(F.col("r")).alias("t")).collect()]
    assert (t[0].func, t[0].imports, t[0].wrapper, t[0].retry) == ("fn f() {}", "use a;", "w", False)
    assert (t[1].imports, t[1].wrapper, t[1].retry) == ("", "w", False)
    assert t[2].retry
    open_end = spark.createDataFrame([("<FUNC>\nf\n</FUNC>\n<WRAPPER>\nnever closed",)], "r string")
    o = open_end.select(X.extract_tags(F.col("r")).alias("t")).first().t
    assert (o.func, o.wrapper, o.retry) == ("f", "never closed", False)


def test_verdicts(spark):
    tests = spark.createDataFrame([("f", 1, 1, "t1", "passed", None), ("f", 1, 2, "t2", "failed", "boom"),
                                   ("f", 1, 3, "t3", "failed", "late"), ("g", 1, 1, "t1", "passed", None)],
                                  "func string, attempt int, ordinal int, test string, status string, error string")
    suites = spark.createDataFrame([("f", 1), ("g", 1), ("h", 1)], "func string, attempt int")
    sp = {r.func: (r.passed, r.n_tests) for r in X.suite_passed(suites, tests).collect()}
    assert sp == {"f": (False, 3), "g": (True, 1), "h": (True, 0)}
    ff = X.first_failure(tests).first()
    assert (ff.test, ff.error) == ("t2", "boom")
    assert X.stop_on_failure(tests).where("func = 'f'").count() == 2
    att = spark.createDataFrame([("f", 1, False, "Compile Error"), ("f", 2, True, "x"), ("f", 3, False, "y"),
                                 ("g", 1, False, "Compile Error"), ("g", 2, False, "Test Failure")],
                                "func string, attempt int, success boolean, category string")
    o = {r.func: (r.result, r.attempts_used) for r in X.attempt_outcomes(att, 5).collect()}
    assert o == {"f": ("Success", 2), "g": ("Test Failure", 2)}
    o1 = {r.func: (r.result, r.attempts_used) for r in X.attempt_outcomes(att, 0).collect()}
    assert o1 == {"f": ("Compile Error", 1), "g": ("Compile Error", 1)}
    msg = spark.createDataFrame([("Timeout in rust-lld: error: x",), ("rust-lld: error: y",), ("E0308",)], "m string")
    assert [r.k for r in msg.select(X.classify_failure(F.col("m")).alias("k")).collect()] == [
        "timeout", "linker", "compile error"]
    msg = spark.createDataFrame([("Timeout", "Test Failure"), (None, "Compile Error")], "m string, c string")
    assert [r.k for r in msg.select(X.classify_failure(F.col("m"), F.col("c")).alias("k")).collect()] == ["test failure", None]
    assert {r.func: r.attempts_used for r in X.attempt_outcomes(att).collect()} == {"f": 2, "g": 2}


def test_make_targets_and_golden(spark):
    db = spark.createDataFrame([(1, "all: a b"), (1, ".PHONY: all clean"), (1, "clean:"), (1, "app: main.o"),
                                (1, "CC=cc"), (1, "X:=1"), (1, "Makefile: x"), (2, "a:"), (2, "b:"), (3, "all:"), (3, ".PHONY: all")],
                               "project int, line string")
    real, report = X.executable_targets(db)
    assert {(r.project, r.target) for r in real.collect()} == {(1, "app"), (2, "a"), (2, "b")}
    assert sorted((r.project, r.n_targets) for r in report.collect()) == [(2, 2), (3, 0)]
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "l string")
    e = spark.createDataFrame([("x",), ("y",), ("z",)], "l string")
    assert {(r.l, r.side) for r in X.compare_golden(a, e).collect()} == {("z", "expected_only"), ("y", "actual_only")}


def test_provider_messages_and_registry(spark):
    m = spark.createDataFrame([(1, "system", "s"), (2, "user", "u"), (3, "assistant", "a")], "turn int, role string, text string")
    assert [r.role for r in X.provider_messages(m, "contents").orderBy("turn").collect()] == ["user", "model"]
    assert [r.role for r in X.provider_messages(m, "messages").orderBy("turn").collect()] == ["user", "assistant"]
    req = spark.createDataFrame([(1, "small"), (2, "nope")], "id int, model string")
    reg = spark.createDataFrame([("small", "p", "m1")], "model string, provider string, model_id string")
    ok, bad = X.lookup_models(req, reg)
    assert [r.id for r in ok.collect()] == [1] and [r.id for r in bad.collect()] == [2]
