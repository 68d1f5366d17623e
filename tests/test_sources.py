"""File sources and sinks: logs cut into splits, ordered files, blobs, gzip
members, rejects, open keys; mergeable run state."""

import gzip
import os
import random
import tempfile
from contextlib import contextmanager

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.functions import trace_text as TT
from corvid.operators import bytes as Z
from corvid.operators import graph as G
from corvid.operators import trace as T
from corvid.operators import translate as X
from corvid.sources import blobs, files, gzip_members, ordered_text, trace_files
from corvid.streaming import trace_stream as S


@contextmanager
def small_splits(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def folder(kind):
    return tempfile.mkdtemp(prefix=f"{kind}-", dir="/tmp")


# ---------------------------------------------------------------- T1
def records(names):
    return [f'{{ "name": "{n}", "args": {{"k" : "line\nbreak {i}"}}, "return": ["{i}"' for i, n in enumerate(names)]


def test_trace_order_is_gapless_over_many_splits_and_pieces(spark):
    d, names = folder("log"), [f"f{i}" for i in range(400)]
    os.makedirs(f"{d}/file=b/piece=1")
    for log, piece, part in (("a", "", names[:300]), ("b/piece=0", "", names[:37]), ("b/piece=1", "", names[37:90])):
        os.makedirs(f"{d}/file={log}", exist_ok=True)
        with open(f"{d}/file={log}/part-0.txt", "w") as f:
            f.write("".join(r + TT.RECORD_END for r in records(part)) + " \n")
    with small_splits(spark, 700):
        raw = trace_files.read_trace(spark, d)
        rows = T.record_names(raw).select("log", "file", "block_start", "seq", "name").collect()
    assert len({(r.file, r.block_start) for r in rows if r.log == "a"}) >= 20
    assert sorted((r.seq, r.name) for r in rows if r.log == "a") == list(enumerate(names[:300]))
    assert sorted((r.seq, r.name) for r in rows if r.log == "b") == list(enumerate(names[:90]))


def test_record_name_is_read_without_the_arguments(spark):
    rows = [(1, ' \n{ "name": "f", "args": {"a" : "1", "a" : "2"}, "return": ['), (2, '"], "return": ["5"'), (3, '{ "name": "g"'), (4, "")]
    got = T.record_names(spark.createDataFrame(rows, "i long, value string")).collect()
    assert [(r.i, r.name) for r in got] == [(1, "f")]


def test_texts_inside_values_do_not_cut_a_record(spark):
    v = 'x"}, "return": ["y", "args": {"q" : "z'
    df = spark.createDataFrame([("f", ["a", "b"], [v, "1"], ["7", "8"]), ("g", [], [], [])],
                               "name string, keys array<string>, vals array<string>, ret array<string>")
    text = df.select(TT.render_record(F.col("name"), F.col("ret"), F.col("keys"), F.col("vals")).alias("value"))
    by_column = [r.p for r in text.select(TT.parse_trace(F.col("value")).alias("p")).collect()]
    good, bad = T.parse_records(text)
    by_frame = good.collect()
    assert bad.count() == 0 and by_column[0].ret == ["7", "8"] == by_frame[0].ret
    assert [p.args for p in by_column] == [r.args for r in by_frame] and by_frame[1].args == {}


def test_repeated_and_missing_parameter_names(spark):
    inv = spark.createDataFrame([("f", ["_2", "", "x", "x", "x_4", None, "x"], False), ("n", None, True)],
                                "name string, param_names array<string>, struct_return boolean")
    tr = spark.createDataFrame([("f", list("abcdefg")), ("n", ["1"])], "name string, pos_args array<string>")
    named, extra = T.name_positional_args(tr, inv)
    got = {r.name: r.args for r in named.collect()}
    assert got["f"] == {"_2": "a", "_2_2": "b", "x": "c", "x_4": "d", "x_4_5": "e", "_6": "f", "x_7": "g"} and got["n"] == {}
    assert [(r.name, r.value) for r in extra.collect()] == [("n", "1")]


# ---------------------------------------------------------------- T13
stretch = st.lists(st.sampled_from("m.x"), max_size=12)


def state_of(flags):
    """(markers, head, head main, tail, tail main) of a string of records: m marker, x main."""
    if not flags:
        return S.EMPTY
    part = "".join(flags).split("m")
    head, tail = part[0], ("m" + part[-1] if len(part) > 1 else part[0])
    return len(part) - 1, len(head), "x" in head, len(tail), "x" in tail


@settings(max_examples=200, deadline=None)
@given(stretch, stretch, stretch)
def test_run_state_is_associative(a, b, c):
    x, y, z = map(state_of, (a, b, c))
    assert S.merge_states(S.merge_states(x, y), z) == S.merge_states(x, S.merge_states(y, z)) == state_of(a + b + c)
    assert S.merge_states(S.EMPTY, x) == x == S.merge_states(x, S.EMPTY)


def test_runs_over_pieces_that_arrive_late(spark):
    d, r = folder("late"), random.Random(4)
    names = [r.choice(["set_program_name", "main", "f", "f", "f"]) for _ in range(240)]

    def put(piece, part):
        os.makedirs(f"{d}/logs/file=hot/piece={piece:02d}", exist_ok=True)
        with open(f"{d}/logs/file=hot/piece={piece:02d}/p.txt", "w") as f:
            f.write("".join(x + TT.RECORD_END for x in records(part)))

    def check(part):
        runs, k = {0: [0, False]}, 0
        for n in part:
            k += n == "set_program_name"
            run = runs.setdefault(k, [0, False])
            run[0], run[1] = run[0] + 1, run[1] or n == "main"
        want = {i: (n, main, i < k) for i, (n, main) in runs.items() if n}
        got = S.follow_runs(spark, f"{d}/logs", d).collect()
        assert {x.run: (x.records, x.has_main, x.closed) for x in got} == want and {x.log for x in got} == {"hot"}

    with small_splits(spark, 900):
        for piece in (0, 1, 3):
            put(piece, names[piece * 60:piece * 60 + 60])
        check(names[:120] + names[180:])
        put(2, names[120:180])
        check(names)


# ---------------------------------------------------------------- L1
def test_line_numbers_over_files_and_splits(spark):
    d, r = folder("text"), random.Random(2)
    lines = {"b c+d%20.txt": [f"b{i} " + "x" * r.randint(0, 30) for i in range(200)], "a.txt": ["", "only\rone", ""],
             "empty.txt": [], "last.txt": [f"l{i}" for i in range(50)]}
    for name, part in lines.items():
        with open(f"{d}/{name}", "w", newline="") as f:
            f.write("".join(x + "\n" for x in part) if name != "last.txt" else "\n".join(part))
    order = ["last.txt", "b c+d%20.txt", "empty.txt", "a.txt", "last.txt"]
    with small_splits(spark, 256):
        got = ordered_text.numbered_lines(spark, [f"{d}/{n}" for n in order]).collect()
    want, n = [], 0
    for k, name in enumerate(order):
        for i, line in enumerate(lines[name]):
            n += 1
            want.append((k, name, i, n, line))
    assert sorted((x.file_ord, os.path.basename(x.path), x.idx, x.n, x.line) for x in got) == want


def test_files_outside_the_order_are_left_out(spark):
    d = folder("text")
    for name in "abc":
        with open(f"{d}/{name}", "w") as f:
            f.write(f"{name}1\n{name}2\n")
    order = spark.createDataFrame([(f"{d}/c", 5), (f"{d}/a", 9), (f"{d}/none", 1)], "path string, file_ord long")
    got = ordered_text.numbered_lines(spark, d, order).collect()
    assert sorted((x.n, x.line) for x in got) == [(1, "c1"), (2, "c2"), (3, "a1"), (4, "a2")]


# ---------------------------------------------------------------- Z1, Z2
def test_unreadable_blobs_are_rows(spark):
    d = folder("blobs")
    contents = {"a b+c%2.bin": b"\x00\xff", "empty": b"", "packed.gz": gzip.compress(b"plain")}
    for name, data in contents.items():
        with open(f"{d}/{name}", "wb") as f:
            f.write(data)
    paths = [f"{d}/{n}" for n in contents] + [f"{d}/gone", d]
    manifest = blobs.write_manifest(spark.createDataFrame([(p,) for p in paths], "path string"), f"{folder('m')}/manifest")
    got = {os.path.basename(r.path): (r.length, r.content, r.error) for r in blobs.read_listed_blobs(spark, manifest).collect()}
    assert got.pop("gone") == (None, None, "FileNotFoundError")
    broken = got.pop(os.path.basename(d))
    assert broken[:2] == (None, None) and broken[2]
    assert got == {n: (len(x), x, None) for n, x in contents.items()}
    listed = {os.path.basename(r.path): bytes(r.content) for r in blobs.read_blobs(spark, d).collect()}
    assert listed == contents
    assert blobs.read_blobs(spark, d, "*.gz").count() == 1
    os.makedirs(f"{d}/deep/er")
    with open(f"{d}/deep/er/x", "w") as f:
        f.write("x")
    got = {r.path[len(d) + 1:]: (r.length, r.error) for r in blobs.read_blobs(spark, f"file:{d}").collect()}
    assert got == {n: (len(x), None) for n, x in contents.items()} | {"deep/er/x": (1, None)}
    # a file that goes between planning and reading
    reader = blobs.BlobSource({"path": d, "glob": "p*"}).reader(None)
    (part,) = reader.partitions()
    os.remove(f"{d}/packed.gz")
    (batch,) = reader.read(part)
    assert batch.to_pylist() == [{"path": f"{d}/packed.gz", "length": None, "content": None, "error": "FileNotFoundError"}]
    assert blobs.read_blobs(spark, folder("none")).count() == 0


def test_gzip_members_are_read_by_several_tasks(spark):
    d, r = folder("gz"), random.Random(1)
    values = [None, "", "two\nlines", "tail\n", "é" * 50] + ["".join(r.choice("abc \n") for _ in range(r.randint(0, 90))) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").coalesce(1)
    gzip_members.write_gzip(df, f"{d}/out", "v", member_bytes=500, file_bytes=4000)
    back = gzip_members.read_gzip(spark, f"{d}/out", split_bytes=700)
    lines = "".join((v or "") + "\n" for v in values).split("\n")[:-1]
    rows = sorted(back.collect(), key=lambda x: (x.file, x.member, x.line_no))
    assert [x.value for x in rows] == lines
    names = sorted(n for n in os.listdir(f"{d}/out") if n.endswith(".gz"))
    assert len(names) > 1 and back.rdd.getNumPartitions() > len(names)
    assert not os.path.exists(f"{d}/out/_writing")
    # any gzip reader gets the lines
    assert b"".join(gzip.open(f"{d}/out/{n}").read() for n in names).decode().split("\n")[:-1] == lines
    assert sorted(x.value for x in spark.read.option("lineSep", "\n").text(f"{d}/out").collect()) == sorted(lines)
    index = gzip_members.member_index(spark, f"{d}/out")
    assert index.agg(F.sum("lines"), F.sum("plain")).first()[:] == (len(lines), sum(len(x.encode()) + 1 for x in lines))


# ---------------------------------------------------------------- B1, C2, X1, X3, R1
def test_sample_rejects(spark):
    d = folder("csv")
    with open(f"{d}/s.csv", "w") as f:
        f.write("FuncName, Length, Result\nf, 12, Success\ng, twelve, Failure\nh, 3\n, 4, Success\nk, 5, Perhaps\nl, , Success\n"
                "m, 7, Failure, more\nn, 8, Failure\n")
    good, bad = files.read_samples_checked(spark, d)
    assert sorted(tuple(r) for r in good.collect()) == [("f", 12, "Success"), ("n", 8, "Failure")]
    assert sorted((r.record, r.reason) for r in bad.collect()) == [
        (", 4, Success", "no name"), ("g, twelve, Failure", "malformed"), ("h, 3", "malformed"), ("k, 5, Perhaps", "no verdict"),
        ("l, , Success", "no length"), ("m, 7, Failure, more", "malformed")]


def test_a_second_run_replaces_its_project_alone(spark):
    d, kind = folder("inv"), "project string, name string, calledFunctions array<string>"
    files.write_functions(spark.createDataFrame([("p", "f", ["g"]), ("p", "g", None), ("q", "h", [])], kind), d)
    files.write_functions(spark.createDataFrame([("p", "f2", [])], kind), d)
    got = {(r.project, r.name): r.calledFunctions for r in files.read_inventory(spark, d).collect()}
    assert got == {("p", "f2"): [], ("q", "h"): []}


def test_keys_that_the_formats_do_not_name_come_back(spark):
    d = folder("json")
    os.makedirs(f"{d}/logs")
    with open(f"{d}/logs/1.json", "w") as f:
        f.write('{"date": "2024", "attempts": 2, "seed": 5, "model": "m",\n "results": [{"function": "f", "results": "Success", "ms": 1.5},'
                ' {"function": "g"}]}')
    with open(f"{d}/logs/2.json", "w") as f:
        f.write('{"date": 7, "attempts": "x", "results": []}')
    with open(f"{d}/logs/3.json", "w") as f:
        f.write("[1, 2]")
    with open(f"{d}/logs/4.json", "w") as f:
        f.write("no json {")
    rows = {r.model: r for r in files.read_run_logs(spark, f"{d}/logs").collect()}
    assert set(rows) == {"m", None} and rows["m"].other == {"seed": "5"} and rows["m"].attempts == 2
    assert [(x.function, x.results, x.other) for x in rows["m"].results] == [("f", "Success", {"ms": "1.5"}), ("g", None, {})]
    assert rows[None].date == "7" and rows[None].attempts is None and rows[None].results == []
    assert {(r.model, r.result): r.functions for r in X.result_summary(files.read_run_logs(spark, f"{d}/logs")).collect()} == {
        ("m", "Success"): 1, ("m", None): 1, (None, None): 0}


# ---------------------------------------------------------------- Z10, G4
def test_many_ranges_match_a_plain_count(spark):
    from collections import Counter
    r = random.Random(3)
    texts = ["", "aé𝄞a" * 700, "x" * 9000, "".join(chr(r.randint(32, 70000)) for _ in range(6000)).encode("utf-8", "ignore").decode(), None]
    rows = [(i, t) for i, t in enumerate(texts)]
    ranges = [(i, k, r.randint(-3, 9100), r.randint(-3, 9100)) for i in range(5) for k in range(40)] + [(1, 99, 0, 2800)]
    got = Z.range_histograms(spark.createDataFrame(rows, "doc_id long, text string"),
                             spark.createDataFrame(ranges, "doc_id long, range_id long, lo long, hi long"), ["doc_id"]).collect()
    want = {}
    for i, k, lo, hi in ranges:
        for c, n in Counter((texts[i] or "")[max(lo, 0):max(hi, 0)]).items():
            want[i, k, c] = n
    assert {(x.doc_id, x.range_id, x.symbol): x["count"] for x in got} == want


def test_components_with_a_hub_and_random_edges(spark):
    r = random.Random(6)
    pairs = [("hub", f"s{i}") for i in range(3000)] + [(f"n{r.randint(0, 400)}", f"n{r.randint(0, 400)}") for _ in range(260)]
    pairs += [("n0", "s5"), ("z", "z")] + pairs[:3]
    parent = {x: x for p in pairs for x in p} | {"alone": "alone"}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    nodes = spark.createDataFrame([(n,) for n in parent], "n string")
    got = {x.n: x.label for x in G.weak_components(nodes, spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {n: find(n) for n in parent}
    assert G.weak_components(nodes, spark.createDataFrame([], "src string, dst string")).where("n <> label").count() == 0


@pytest.mark.parametrize("rounds", [1, 8])
def test_deep_graphs_are_searched_in_merged_tables(spark, rounds, monkeypatch):
    monkeypatch.setattr(G, "MERGE_ROUNDS", rounds)
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n3", "n1")], "src string, dst string")
    n = e.select(F.col("src").alias("n")).union(e.select("dst")).distinct()
    assert {r.n: r.depth for r in G.reachable(n, e, "n0").collect()} == {f"n{i}": i for i in range(13)}


# ---------------------------------------------------------------- plans
def exchanged(df):
    """The columns of every hash or range exchange of the plan."""
    import re
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (?:hash|range)partitioning\(([^)]*)\)", plan), plan


def test_no_text_is_on_a_shuffled_side(spark):
    """Lines and spans meet narrow facts where their text is read."""
    from corvid.operators import lines as L
    from corvid.plans import views
    from conftest import SF_SMALL
    for options in ({}, {"nonblank": True}, {"squeeze": True}):
        _, plan = exchanged(L.number_files(views.line_files(spark, SF_SMALL), **options))
        head = plan[:plan.index("BroadcastHashJoin")]
        assert "Exchange" not in head and "SortMergeJoin" not in plan.split("BroadcastExchange")[0]
    spans = views.spans(spark, SF_SMALL)
    for df in (X.extract_span_in_files(spans, views.src_files(spark, SF_SMALL)), X.comment_out_span_in_files(spans, views.src_files(spark, SF_SMALL))):
        _, plan = exchanged(df)
        assert "Exchange" not in plan[:plan.index("BroadcastHashJoin")] and "SortMergeJoin" not in plan
