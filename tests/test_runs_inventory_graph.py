"""Unit checks with hand-written rows: rubrics, inventory quirks, cyclic graphs."""

import pytest
from pyspark.sql import functions as F

from corvid.functions import code
from corvid.operators import graph as G
from corvid.operators import inventory as C
from corvid.operators import runs as R
from corvid.plans import ordering, views

README_A = """# Task

## Evaluation Criteria

User Experience:
- Explains the plan before editing: 4
- Asks before deleting files: 3*

Correctness:
- Handles the `*` case: with care: 5
- Program builds: 8
"""

README_B = """Intro text that is not a rubric.
Correctness:
- Output matches: 10
- Exits cleanly: 6
User Experience:
- Short answer: 5
"""


def _readmes(spark):
    return spark.createDataFrame([("creation", "task1", README_A), ("debugging", "task2", README_B)],
                                 "category string, task string, readme string")


def test_parse_rubric_sections_points_and_stars(spark):
    r = R.parse_rubric(_readmes(spark)).orderBy("category", "ordinal").collect()
    a = [x for x in r if x.task == "task1"]
    assert [(x.section, x.points) for x in a] == [("User Experience", 4), ("User Experience", 3),
                                                 ("Correctness", 5), ("Correctness", 8)]
    assert a[2].criterion == "Handles the `*` case: with care"
    assert a[1].criterion == "Asks before deleting files"


def test_rubric_total_check_flags_21(spark):
    rub = R.parse_rubric(_readmes(spark))
    bad = {(x.task, x.total) for x in R.rubric_total_check(rub, 20).collect()}
    assert bad == {("task2", 21)}


def test_rubric_rows_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordering, "TASK_ROWS", 100, raising=False)
    li = [(k // 4, 1 + k % 4, float(k % 9), 0.01, "AN"[k % 2], "FO"[k % 3 % 2]) for k in range(1200)] + [(None, 1, 2.0, None, None, "O")]
    spark.createDataFrame(li, "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_returnflag string,"
                          " l_linestatus string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = R.parse_rubric(views.rubric_readmes(spark, str(tmp_path)))
    assert got.rdd.getNumPartitions() == 13
    want, files = set(), {}
    for key, no, quantity, _, flag, status in li[:-1]:
        files.setdefault((flag, f"t{key}"), []).append((status == "F", no, 1 + int(quantity) % 5))
    for (flag, task), items in files.items():
        for k, (fixed, no, points) in enumerate(sorted(items)):
            want.add((flag, task, "Correctness" if fixed else "User Experience", k + 1, f"c{no}", points))
    assert sorted(map(tuple, got.where("task is not null").collect())) == sorted(want)
    assert [tuple(r) for r in got.where("task is null").collect()] == [(None, None, "User Experience", 1, "c1", 3)]


def test_score_rollup_levels(spark):
    rub = R.parse_rubric(_readmes(spark)).withColumn("awarded", F.col("points"))
    rows = {(x.category, x.task, x.section, x.level): x.points for x in R.score_rollup(rub).collect()}
    assert rows[(None, None, None, 7)] == 41
    assert rows[("creation", "task1", None, 1)] == 20
    assert rows[("creation", "task1", "Correctness", 0)] == 13


def test_run_name_round_trip_and_pending(spark):
    df = spark.createDataFrame([("c", "t1", "run_alpha_20240102_030405"), ("c", "t1", "junk"),
                                ("c", "t2", "run_beta_x_20231231_235959"), ("d", "t1", "run_gamma_20241399_000000")],
                               "category string, task string, run_name string")
    p = df.select("task", R.parse_run_name(F.col("run_name")).alias("p")).collect()
    assert p[0].p.agent == "alpha" and p[0].p.started_at.strftime("%Y%m%d_%H%M%S") == "20240102_030405"
    assert p[1].p is None
    assert p[2].p.agent == "beta_x"
    assert p[3].p.agent == "gamma" and p[3].p.started_at is None   # a stamp that is no date
    grid = R.run_grid(spark.createDataFrame([("c", "t1"), ("c", "t2")], "category string, task string"),
                      ["alpha", "beta_x", "gamma"])
    pend = {(x.task, x.agent) for x in R.pending_runs(grid, df).collect()}
    # d/t1 has run with gamma, c/t1 has not
    assert pend == {("t1", "beta_x"), ("t1", "gamma"), ("t2", "alpha"), ("t2", "gamma")}


def test_run_outcome_and_cost(spark):
    runs = spark.createDataFrame([("run_a_20240101_000000", 0), ("run_b_20240101_000000", 2)],
                                 "run_name string, return_code int")
    out = {x.run_name: (x.outcome, x.error_log) for x in R.run_outcome(runs).collect()}
    assert out["run_a_20240101_000000"] == ("succeeded", None)
    assert out["run_b_20240101_000000"] == ("failed", "error_log_run_b_20240101_000000.txt")
    chats = spark.createDataFrame([("m", "user", "abcde"), ("m", "user", "abc")], "model string, role string, text string")
    r = R.token_cost(chats, {"m": 2.0}).collect()[0]
    assert (r.tokens, r.n_messages, r.cost) == (3, 2, 6e-06)


def test_outcome_sink_and_inventory_round_trip(spark):
    import tempfile

    from corvid.sources import files as S
    d = tempfile.mkdtemp(prefix="sink-", dir="/tmp")
    runs = spark.createDataFrame([("run_a_20240101_000000", 0), ("run_b_20240101_000000", 3)],
                                 "run_name string, return_code int")
    R.write_outcomes(R.run_outcome(runs), f"{d}/outcomes")
    back = spark.read.parquet(f"{d}/outcomes/outcome=failed").collect()
    assert [(r.run_name, r.error_log) for r in back] == [("run_b_20240101_000000", "error_log_run_b_20240101_000000.txt")]
    inv = spark.createDataFrame([("p1", "f", "a.c", ["g"]), ("p1", "g", "a.c", None), ("p2", "h", "b.c", [])],
                                "project string, name string, filename string, calledFunctions array<string>")
    S.write_functions(inv, f"{d}/inv")
    got = {r.name: (r.project, r.calledFunctions) for r in spark.read.json(f"{d}/inv", schema=
           "name string, filename string, calledFunctions array<string>, project string").collect()}
    assert got == {"f": ("p1", ["g"]), "g": ("p1", None), "h": ("p2", [])}


def test_signature_and_rename(spark):
    df = spark.createDataFrame([("int", "main", ["int", "char**"], ["argc", "argv"]),
                                ("void", "f", ["int", "double"], ["", "x"]), ("char*", "g", [], [])],
                               "ret string, name string, types array<string>, names array<string>")
    s = [x.s for x in df.select(code.build_signature(F.col("ret"), F.col("name"), F.col("types"), F.col("names"))
                                .alias("s")).collect()]
    assert s == ["int main(int argc, char** argv)", "void f(int, double x)", "char* g()"]
    r = [x.n for x in df.select(code.rename_entry("name").alias("n")).collect()]
    assert r == ["main_0", "f", "g"]


def test_attach_callees_absent_empty_and_first_match(spark):
    funcs = spark.createDataFrame([("main", "src/main.c"), ("helper", "a/util.c"), ("lonely", "x.c")],
                                  "name string, filename string")
    edges = spark.createDataFrame([("main", "src/main.c", "helper"), ("main", "src/main.c", "abs"),
                                   ("helper", "b/util.c", "z"), ("helper", "a/util.c", "y")],
                                  "caller string, caller_path string, callee string")
    sets = C.callee_set(edges, ("caller", "caller_path"))
    got = {x.name: x.callees for x in C.attach_callees(funcs, sets).collect()}
    assert got["main"] == ["abs", "helper"]
    assert got["helper"] == ["y"]          # a/util.c sorts before b/util.c
    assert got["lonely"] is None           # absent, not empty


def test_merge_units_and_first_record(spark):
    a = spark.createDataFrame([("f", "a.c", 1), ("g", "a.c", 5)], "name string, filename string, start_line int")
    b = spark.createDataFrame([("f", "a.c", 1), ("f", "b.c", 2)], "name string, filename string, start_line int")
    m = C.merge_units(a, b)
    assert m.count() == 3
    first = {x.name: x.filename for x in C.first_record_per_name(m, ("filename", "start_line")).collect()}
    assert first == {"f": "a.c", "g": "a.c"}


def _graph(spark, pairs):
    e = spark.createDataFrame(pairs, "src string, dst string")
    n = e.select(F.col("src").alias("n")).union(e.select(F.col("dst").alias("n"))).distinct()
    return n, e


def test_reachable_levels_components(spark):
    n, e = _graph(spark, [("main_0", "a"), ("main_0", "b"), ("a", "c"), ("b", "c"), ("x", "y")])
    reach = {r.n: r.depth for r in G.reachable(n, e, "main_0").collect()}
    assert reach == {"main_0": 0, "a": 1, "b": 1, "c": 2}
    lv = {r.n: r.level for r in G.levels_callee_first(n, e).collect()}
    assert lv == {"c": 0, "y": 0, "a": 1, "b": 1, "x": 1, "main_0": 2}
    comp = {r.n: r.label for r in G.weak_components(n, e).collect()}
    assert comp["c"] == "a" and comp["y"] == "x"
    order = [r.n for r in G.callee_first_order(G.levels_callee_first(n, e)).orderBy("position").collect()]
    assert order == ["c", "y", "a", "b", "x", "main_0"]
    with pytest.raises(ValueError):
        G.reachable(n, e, "missing")


def test_cycles_have_no_level(spark):
    n, e = _graph(spark, [("r", "a"), ("a", "r"), ("a", "b"), ("b", "b"), ("q", "w"), ("w", "q")])
    lv = {r.n: r.level for r in G.levels_callee_first(n, e).collect()}
    assert lv["r"] is None and lv["q"] is None


def test_components_on_long_chain_and_reverse_order(spark):
    # chain n039 -> n038 -> ... -> n000 plus a separate pair; labels must be the minimum name
    pairs = [(f"n{i + 1:03d}", f"n{i:03d}") for i in range(39)] + [("z2", "z1")]
    n, e = _graph(spark, pairs)
    comp = {r.n: r.label for r in G.weak_components(n, e).collect()}
    assert set(comp.values()) == {"n000", "z1"} and comp["n039"] == "n000" and comp["z2"] == "z1"
    lv = {r.n: r.level for r in G.levels_callee_first(n, e).collect()}
    assert lv["n000"] == 0 and lv["n039"] == 39


def test_hub_edges_are_not_dealt_to_one_task(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = spark.range(8000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("u"), F.lit("c1").alias("v"))
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition(8).checkpoint()
        x = G._join_least(both, G._least_neighbours(both).checkpoint(), 16000)
        assert x.where("m = 'c1'").count() == 16000
        hub = x.where("u = 'c1'").groupBy(F.spark_partition_id()).count()
        assert hub.agg(F.max("count")).first()[0] < 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_components_are_dealt_by_rows_and_settings_come_back(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TASK_ROWS", 100)
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(k) for k in keys]
    n, e = _graph(spark, [(f"o{i}", "c1") for i in range(1000)])
    got = G.weak_components(n, e)
    assert got.rdd.getNumPartitions() >= 20
    assert {r.label for r in got.collect()} == {"c1"} and [spark.conf.get(k) for k in keys] == old


def test_distinct_arguments_exact_and_approx(spark):
    from corvid.operators import trace as T
    tr = spark.createDataFrame([("f", {"a": "1", "b": "x"}), ("f", {"a": "2", "b": "x"}), ("g", {"a": "1"})],
                               "name string, args map<string,string>")
    exact = {(r.name, r.param): (r.distinct_values, r.calls) for r in T.distinct_arguments(tr).collect()}
    assert exact == {("f", "a"): (2, 2), ("f", "b"): (1, 2), ("g", "a"): (1, 1)}
    approx = {(r.name, r.param): r.distinct_values for r in T.distinct_arguments(tr, approx=True).collect()}
    assert approx == {k: v[0] for k, v in exact.items()}
