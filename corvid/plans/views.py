"""Derived inputs built from the driver tables.

Each view exists twice: as DataFrame code (what the engine runs) and as a
SQL common-table expression (what the DuckDB oracle runs). Both read whole
tables; keys are mapped, never filtered, so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.plans.ordering import materialize, partitions_for
from corvid.sources.tables import table

# ---------------------------------------------------------------- B samples
SAMPLES_SQL = """samples AS (
  SELECT 'd' || CAST(d.doc_id AS VARCHAR) AS func_name, d.n_chars AS length,
         CASE WHEN l.quality = 1 THEN 'Success' ELSE 'Failure' END AS result
  FROM documents d JOIN labels l USING (doc_id))"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id")
            .select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("func_name"),
                    F.col("n_chars").alias("length"),
                    F.when(F.col("quality") == 1, "Success").otherwise("Failure").alias("result")))


# ---------------------------------------------------------------- R runs
# Tasks: one per part, category = part type. Runs: one per lineitem row,
# task = its part, agent = lower(returnflag || linestatus), start = ship date,
# return code = line number mod 3 (0 = success).
AGENTS = ["af", "ao", "nf", "no", "rf", "ro"]

TASKS_SQL = """tasks AS (
  SELECT ['creation', 'debugging', 'refactoring', 'translation'][1 + p_partkey % 4] AS category,
         't' || CAST(p_partkey // 4 AS VARCHAR) AS task FROM part)"""

RUNS_SQL = """runs AS (
  SELECT ['creation', 'debugging', 'refactoring', 'translation'][1 + l_partkey % 4] AS category,
         't' || CAST(l_partkey // 4 AS VARCHAR) AS task,
         lower(l_returnflag || l_linestatus) AS agent,
         l_shipdate AS started_at,
         CASE WHEN l_linenumber = 7 AND l_partkey % 2 = 0 THEN 'run_' || lower(l_returnflag || l_linestatus) || '_20249999_000000'
              ELSE 'run_' || lower(l_returnflag || l_linestatus) || '_' || strftime(l_shipdate, '%Y%m%d_%H%M%S') END AS run_name,
         l_linenumber % 3 AS return_code
  FROM lineitem)"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(_category("p_partkey"), _task("p_partkey"))


def _category(key: str):
    names = F.array(*[F.lit(c) for c in ("creation", "debugging", "refactoring", "translation")])
    return F.get(names, (F.col(key) % 4).cast("int")).alias("category")


def _task(key: str):
    """Names repeat across the categories."""
    return F.concat(F.lit("t"), F.expr(f"{key} div 4").cast("string")).alias("task")


def runs(spark: SparkSession, d: str) -> DataFrame:
    from corvid.operators.runs import format_run_name
    li = (table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_shipdate",
                                                   "l_linenumber"))
    agent = F.lower(F.concat("l_returnflag", "l_linestatus"))
    return li.select(
        _category("l_partkey"), _task("l_partkey"),
        agent.alias("agent"),
        F.col("l_shipdate").alias("started_at"),
        # some stamps are no date
        F.when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 2 == 0), F.concat(F.lit("run_"), agent, F.lit("_20249999_000000")))
        .otherwise(format_run_name(agent, F.col("l_shipdate"))).alias("run_name"),
        (F.col("l_linenumber") % 3).alias("return_code"))


# Rubric rows: one per lineitem row; category = return flag, task = order,
# section by line status, points 1..5 from the quantity, awarded when the
# discount is below 0.05.
RUBRIC_SQL = """rubric AS (
  SELECT l_returnflag AS category, 't' || CAST(l_orderkey AS VARCHAR) AS task,
         CASE WHEN l_linestatus = 'F' THEN 'Correctness' ELSE 'User Experience' END AS section,
         l_linenumber AS ordinal, 'c' || CAST(l_linenumber AS VARCHAR) AS criterion,
         1 + CAST(l_quantity AS INTEGER) % 5 AS points,
         CASE WHEN l_discount < 0.05 THEN 1 + CAST(l_quantity AS INTEGER) % 5 ELSE 0 END AS awarded
  FROM lineitem)"""


def rubric(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    points = F.lit(1) + F.col("l_quantity").cast("int") % 5
    return li.select(
        F.col("l_returnflag").alias("category"),
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("task"),
        F.when(F.col("l_linestatus") == "F", "Correctness").otherwise("User Experience").alias("section"),
        F.col("l_linenumber").alias("ordinal"),
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("criterion"),
        points.alias("points"),
        F.when(F.col("l_discount") < 0.05, points).otherwise(0).alias("awarded"))


def rubric_readmes(spark: SparkSession, d: str) -> DataFrame:
    """One README text per rubric task, rendered from the rubric rows: a
    heading line per section, ``- criterion: points`` lines, odd ordinals
    marked with ``*``. A group is one task's rubric (a handful of lines).
    Rows are dealt by their number, so lists and what is parsed out of them
    later in the same stage take no more of a task on larger tables."""
    n_parts = partitions_for(table(spark, d, "lineitem").count())
    r = rubric(spark, d).drop("awarded").repartition(n_parts, "category", "task")
    so = F.when(F.col("section") == "User Experience", 0).otherwise(1)
    items = r.select("category", "task", F.struct(so.alias("so"), "ordinal", "criterion", "points",
                                                  "section").alias("it"))
    g = items.groupBy("category", "task").agg(F.array_sort(F.collect_list("it")).alias("its"))
    its = F.col("its")

    def line(x, i):
        head = F.when((i == 0) | (F.get(its, i - 1)["section"] != x["section"]),
                      F.concat(x["section"], F.lit(":\n"))).otherwise(F.lit(""))
        star = F.when(x["ordinal"] % 2 == 1, F.lit("*")).otherwise(F.lit(""))
        return F.concat(head, F.lit("- "), x["criterion"], F.lit(": "), x["points"].cast("string"), star)
    text = F.concat(F.lit("## Evaluation Criteria\n\n"), F.array_join(F.transform(its, line), "\n"), F.lit("\n"))
    return g.select("category", "task", text.alias("readme"))


# Chats: conversations with a model picked by conv_id mod 3.
MODELS = ["model-a", "model-b", "model-c"]
# Our own illustrative prices, USD per million tokens.
PRICES = {"model-a": 3.0, "model-b": 15.0, "model-c": 0.5}

CHATS_SQL = """chats AS (
  SELECT conv_id, turn, role, text,
         CASE conv_id % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' ELSE 'model-c' END AS model
  FROM conversations)"""


def chats(spark: SparkSession, d: str) -> DataFrame:
    models = F.array(*[F.lit(m) for m in MODELS])
    return table(spark, d, "conversations").withColumn(
        "model", F.element_at(models, (F.col("conv_id") % 3 + 1).cast("int")))


# ---------------------------------------------------------------- C inventory
# One function record per customer. Every 100th key is a 'main' (one per
# project), the file is the nation's module, lines/columns and parameter
# lists come from key arithmetic. Call edges come from orders joined to the
# caller's customer: caller directory alternates src/lib by order key, the
# callee is the function of key o_orderkey DIV 10.
FUNCTIONS_SQL = """functions AS (
  SELECT CASE WHEN c_custkey % 100 = 0 THEN 'main' ELSE 'f' || CAST(c_custkey AS VARCHAR) END AS name,
         'src/m' || CAST(c_nationkey AS VARCHAR) || '.c' AS filename,
         CAST(c_custkey % 500 + 1 AS BIGINT) AS start_line,
         CAST(c_custkey % 500 + 1 + c_custkey % 40 AS BIGINT) AS end_line,
         CAST(1 + c_custkey % 7 AS BIGINT) AS start_col,
         CAST(1 + c_custkey % 11 AS BIGINT) AS end_col,
         CAST(c_custkey % 4 AS INTEGER) AS num_args,
         CASE c_custkey % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'void' WHEN 2 THEN 'char*' ELSE 'double' END AS return_type,
         c_acctbal >= -500 AS is_valid_location,
         c_mktsegment = 'AUTOMOBILE' AS is_system,
         c_custkey % 3 <> 0 AS is_definition,
         c_custkey
  FROM customer)"""

CALL_EDGES_SQL = """call_edges AS (
  SELECT CASE WHEN c.c_custkey % 100 = 0 THEN 'main' ELSE 'f' || CAST(c.c_custkey AS VARCHAR) END AS caller,
         CASE WHEN o.o_orderkey % 2 = 0 THEN 'src/m' ELSE 'lib/m' END || CAST(c.c_nationkey AS VARCHAR) || '.c' AS caller_path,
         CASE WHEN (o.o_orderkey // 10) % 100 = 0 THEN 'main' ELSE 'f' || CAST(o.o_orderkey // 10 AS VARCHAR) END AS callee
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

PARAM_TYPES = ["int", "char*", "double"]
PARAM_NAMES = ["argc", "", "x"]
RETURN_TYPES = ["int", "void", "char*", "double"]


def _fname(key: F.Column) -> F.Column:
    return F.when(key % 100 == 0, F.lit("main")).otherwise(F.concat(F.lit("f"), key.cast("string")))


def functions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    rets = F.array(*[F.lit(t) for t in RETURN_TYPES])
    return c.select(
        _fname(k).alias("name"),
        F.concat(F.lit("src/m"), F.col("c_nationkey").cast("string"), F.lit(".c")).alias("filename"),
        (k % 500 + 1).alias("start_line"),
        (k % 500 + 1 + k % 40).alias("end_line"),
        (1 + k % 7).alias("start_col"),
        (1 + k % 11).alias("end_col"),
        (k % 4).cast("int").alias("num_args"),
        F.element_at(rets, (k % 4 + 1).cast("int")).alias("return_type"),
        (F.col("c_acctbal") >= -500).alias("is_valid_location"),
        (F.col("c_mktsegment") == "AUTOMOBILE").alias("is_system"),
        (k % 3 != 0).alias("is_definition"),
        k.alias("c_custkey"))


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    prefix = F.when(F.col("o_orderkey") % 2 == 0, F.lit("src/m")).otherwise(F.lit("lib/m"))
    return j.select(_fname(F.col("c_custkey")).alias("caller"),
                    F.concat(prefix, F.col("c_nationkey").cast("string"), F.lit(".c")).alias("caller_path"),
                    _fname(F.floor(F.col("o_orderkey") / 10).cast("bigint")).alias("callee"))


# ---------------------------------------------------------------- G call graph
# Acyclic call graph over function names (numbers only grow along an edge):
# customer c gives (parent, f{c+1}) with parent = c DIV (2 + nation mod 3),
# named 'x..' (an unreachable caller) when the balance is negative, else
# 'f..'; order rows give (f{custkey DIV 7}, f{custkey+1}). Root: 'f0'.
GRAPH_ROOT = "f0"

GRAPH_EDGES_SQL = """graph_edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT CASE WHEN c_acctbal < 0 THEN 'x' ELSE 'f' END || CAST(c_custkey // (2 + c_nationkey % 3) AS VARCHAR) AS src,
           'f' || CAST(c_custkey + 1 AS VARCHAR) AS dst FROM customer
    UNION ALL
    SELECT 'f' || CAST(o_custkey // 7 AS VARCHAR), 'f' || CAST(o_custkey + 1 AS VARCHAR) FROM orders)),
graph_nodes AS (SELECT src AS n FROM graph_edges UNION SELECT dst FROM graph_edges)"""


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    o = table(spark, d, "orders")
    pre = F.when(F.col("c_acctbal") < 0, F.lit("x")).otherwise(F.lit("f"))
    a = c.select(F.concat(pre, F.floor(F.col("c_custkey") / (2 + F.col("c_nationkey") % 3)).cast("bigint")
                          .cast("string")).alias("src"),
                 F.concat(F.lit("f"), (F.col("c_custkey") + 1).cast("string")).alias("dst"))
    b = o.select(F.concat(F.lit("f"), F.floor(F.col("o_custkey") / 7).cast("bigint").cast("string")).alias("src"),
                 F.concat(F.lit("f"), (F.col("o_custkey") + 1).cast("string")).alias("dst"))
    return a.union(b).distinct()


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("n")).union(edges.select(F.col("dst").alias("n"))).distinct()


# One giant component: orders hang on customers, customers on nations, nations
# on regions, and regions form a chain.
GIANT_SQL = """giant_nodes AS (
  SELECT DISTINCT n, k FROM (
    SELECT 'o' || o_orderkey AS n, o_custkey AS k FROM orders UNION ALL SELECT 'c' || o_custkey, o_custkey FROM orders
    UNION ALL SELECT 'c' || c_custkey, c_custkey FROM customer UNION ALL SELECT 'n' || c_nationkey, NULL FROM customer
    UNION ALL SELECT 'n' || n_nationkey, NULL FROM nation UNION ALL SELECT 'r' || n_regionkey, NULL FROM nation
    UNION ALL SELECT 'r' || r_regionkey, NULL FROM region))"""


def giant_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def node(letter: str, key) -> Column:
        return F.concat(F.lit(letter), key.cast("string"))
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    edges = (o.select(node("c", F.col("o_custkey")).alias("src"), node("o", F.col("o_orderkey")).alias("dst"))
             .union(c.select(node("n", F.col("c_nationkey")), node("c", F.col("c_custkey"))))
             .union(n.select(node("r", F.col("n_regionkey")), node("n", F.col("n_nationkey"))))
             .union(r.select(node("r", F.col("r_regionkey")), node("r", F.greatest(F.col("r_regionkey") - 1, F.lit(0))))))
    # dealt by counted rows: a task sorts and hashes no more of them on larger tables
    n_parts = partitions_for(sum(x.count() for x in (o, c, n, r)))
    edges = materialize(edges.repartition(n_parts, "src", "dst").distinct(), "edges")
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    return nodes, edges


# ---------------------------------------------------------------- T traces
# One trace record per event: log file = user_id mod 10, seq = event_id,
# name from the event type (signup starts a run, purchase is the entry
# point), named args user/props (views carry a raw newline), return = the
# value printed with %f (errors return nothing).
TRACE_SQL = """trace AS (
  SELECT user_id % 10 AS file, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'set_program_name' WHEN 'purchase' THEN 'main' ELSE event_type END AS name,
         CAST(user_id AS VARCHAR) AS a_user,
         CASE WHEN event_type = 'view' THEN props || chr(10) || 'line2' ELSE props END AS a_props,
         CASE WHEN event_type = 'error' THEN NULL ELSE printf('%f', value) END AS ret
  FROM events)"""


def trace_raw(spark: SparkSession, d: str, terminator: bool = True, day: bool = False) -> DataFrame:
    """Rendered records (T2 format) for every event: ``(file, seq, value)``,
    and the event's day if asked for."""
    from corvid.functions.trace_text import render_record
    e = (table(spark, d, "events"))
    et = F.col("event_type")
    name = (F.when(et == "signup", F.lit("set_program_name")).when(et == "purchase", F.lit("main"))
            .otherwise(et))
    props = F.when(et == "view", F.concat("props", F.lit("\n"), F.lit("line2"))).otherwise(F.col("props"))
    keys = F.array(F.lit("user"), F.lit("props"))
    vals = F.array(F.col("user_id").cast("string"), props)
    ret = F.when(et == "error", F.array().cast("array<string>")).otherwise(
        F.array(F.format_string("%f", F.col("value"))))
    return e.select((F.col("user_id") % 10).alias("file"), F.col("event_id").alias("seq"),
                    *([F.to_date("ts").alias("day")] if day else []),
                    render_record(name, ret, keys, vals, terminator=terminator).alias("value"))


def trace(spark: SparkSession, d: str) -> DataFrame:
    """Parsed trace ``(file, seq, name, args, pos_args, ret)`` (T2 -> T11 round trip)."""
    from corvid.operators.trace import parse_records
    good, _ = parse_records(trace_raw(spark, d))
    return good


TYPED_SQL = """typed AS (
  SELECT event_id AS seq, 'int' AS ctype, CASE WHEN event_id % 97 = 0 THEN 'oops' ELSE CAST(user_id AS VARCHAR) END AS raw FROM events
  UNION ALL SELECT event_id, 'double', CAST(value AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'char*', CASE WHEN event_type = 'view' THEN repeat(props, 20) ELSE props END FROM events
  UNION ALL SELECT event_id, 'void*', CASE WHEN event_id % 89 = 0 THEN '18446744073709551615' WHEN event_id % 89 = 1 THEN 'x' ELSE CAST(event_id * 4096 AS VARCHAR) END FROM events
  UNION ALL SELECT event_id, 'struct stat', '' FROM events)"""


def typed_values(spark: SparkSession, d: str) -> DataFrame:
    e = (table(spark, d, "events")).select(
        F.col("event_id").alias("seq"), "value",
        F.when(F.col("event_id") % 97 == 0, "oops").otherwise(F.col("user_id").cast("string")).alias("whole"),
        # the largest unsigned 64-bit value, and text that is no number
        F.when(F.col("event_id") % 89 == 0, str((1 << 64) - 1)).when(F.col("event_id") % 89 == 1, "x")
        .otherwise((F.col("event_id") * 4096).cast("string")).alias("address"),
        F.when(F.col("event_type") == "view", F.repeat("props", 20)).otherwise(F.col("props")).alias("chars"))
    return e.select("seq", F.expr(
        "stack(5, 'int', whole, 'double', cast(value as string), 'char*', chars, "
        "'void*', address, 'struct stat', '') as (ctype, raw)"))


POSITIONAL_SQL = """pos AS (
  SELECT event_id AS seq,
         CASE WHEN user_id % 100 = 0 THEN 'main' ELSE 'f' || CAST(user_id AS VARCHAR) END AS name,
         [CAST(user_id AS VARCHAR), props, printf('%f', value), CAST(event_id AS VARCHAR)] AS vals
  FROM events)"""


def positional_trace(spark: SparkSession, d: str) -> DataFrame:
    """Old-format records (positional args) for every event, parsed back."""
    from corvid.functions.trace_text import render_record
    from corvid.operators.trace import parse_records
    e = (table(spark, d, "events"))
    name = _fname(F.col("user_id"))
    vals = F.array(F.col("user_id").cast("string"), F.col("props"), F.format_string("%f", F.col("value")),
                   F.col("event_id").cast("string"))
    raw = e.select((F.col("user_id") % 10).alias("file"), F.col("event_id").alias("seq"),
                   render_record(name, F.array().cast("array<string>"), positional=vals).alias("value"))
    good, _ = parse_records(raw)
    return good


# ---------------------------------------------------------------- X translation
# Attempts: lineitem grouped by (order, line number) because the pair repeats.
ATTEMPTS_SQL = """attempts AS (
  SELECT 'f' || CAST(l_orderkey AS VARCHAR) AS func, l_orderkey AS okey, l_linenumber AS attempt,
         bool_or(l_returnflag = 'N') AS success,
         CASE WHEN min(l_linestatus) = 'F' THEN 'Test Failure' ELSE 'Compile Error' END AS category
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

TESTS_SQL = """tests AS (
  SELECT 'f' || CAST(l_orderkey AS VARCHAR) AS func, 1 + l_linenumber % 2 AS attempt,
         l_partkey AS ordinal,
         'test_' || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) AS test,
         CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'passed' END AS status,
         CASE WHEN l_returnflag = 'R' THEN 'assertion failed at line ' || CAST(l_linenumber AS VARCHAR) END AS error
  FROM lineitem)"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return (li.groupBy("l_orderkey", "l_linenumber")
            .agg(F.bool_or(F.col("l_returnflag") == "N").alias("success"),
                 F.min("l_linestatus").alias("_ls"))
            .select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("func"),
                    F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("attempt"), "success",
                    F.when(F.col("_ls") == "F", "Test Failure").otherwise("Compile Error").alias("category")))


def tests(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    failed = F.col("l_returnflag") == "R"
    return li.select(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("func"),
        (F.lit(1) + F.col("l_linenumber") % 2).alias("attempt"),
        F.col("l_partkey").alias("ordinal"),
        F.concat(F.lit("test_"), F.col("l_partkey").cast("string"), F.lit("_"),
                 F.col("l_suppkey").cast("string")).alias("test"),
        F.when(failed, "failed").otherwise("passed").alias("status"),
        F.when(failed, F.concat(F.lit("assertion failed at line "), F.col("l_linenumber").cast("string")))
        .alias("error"))


COMMANDS_SQL = """commands AS (
  SELECT p_partkey AS id, '/work/' || lower(replace(p_brand, '#', '')) AS directory,
         CASE WHEN p_size % 2 = 0 THEN '/abs/' || replace(p_name, ' ', '_') || '.c'
              ELSE replace(p_name, ' ', '_') || '.c' END AS file,
         ['cc', '-Iinclude', '-I  ' || lower(p_type), '-O2', '-Ilib/' || CAST(p_size AS VARCHAR), '-c',
          '-Iinclude'] AS arguments
  FROM part)"""


def commands(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit(".c"))
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("/work/"), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("directory"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/abs/"), name)).otherwise(name).alias("file"),
        F.array(F.lit("cc"), F.lit("-Iinclude"), F.concat(F.lit("-I  "), F.lower("p_type")), F.lit("-O2"),
                F.concat(F.lit("-Ilib/"), F.col("p_size").cast("string")), F.lit("-c"), F.lit("-Iinclude"))
        .alias("arguments"))


MESSAGES_SQL = """messages AS (
  SELECT l_orderkey AS okey, l_linenumber AS attempt,
         CASE l_returnflag WHEN 'R' THEN 'Timeout after 60 s running test_' || CAST(l_partkey AS VARCHAR)
              WHEN 'A' THEN 'rust-lld: error: undefined symbol: f' || CAST(l_partkey AS VARCHAR)
              ELSE 'error[E0308]: mismatched types in f' || CAST(l_orderkey AS VARCHAR) END
         || CASE WHEN l_linestatus = 'F' THEN ' (Timeout)' WHEN l_linenumber = 6 THEN NULL ELSE '' END AS message,
         CASE WHEN l_linenumber = 5 THEN 'Test Failure' ELSE 'Compile Error' END AS category
  FROM lineitem)"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    rf = F.col("l_returnflag")
    base = (F.when(rf == "R", F.concat(F.lit("Timeout after 60 s running test_"), F.col("l_partkey").cast("string")))
            .when(rf == "A", F.concat(F.lit("rust-lld: error: undefined symbol: f"), F.col("l_partkey").cast("string")))
            .otherwise(F.concat(F.lit("error[E0308]: mismatched types in f"), F.col("l_orderkey").cast("string"))))
    tail = F.when(F.col("l_linestatus") == "F", F.lit(" (Timeout)")).when(F.col("l_linenumber") != 6, F.lit(""))
    return li.select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("attempt"),
                     F.concat(base, tail).alias("message"),
                     F.when(F.col("l_linenumber") == 5, "Test Failure").otherwise("Compile Error").alias("category"))


# Source lines: documents with one sentence per line; one span per document.
SRC_LINES_SQL = """src_lines AS (
  SELECT file, CAST(i AS BIGINT) AS line_no, parts[i] AS line FROM (
    SELECT doc_id AS file, parts, unnest(generate_series(1, len(parts))) AS i
    FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS parts FROM documents))),
spans AS (
  SELECT doc_id AS span_id, doc_id AS file, 1 + doc_id % 3 AS start_line, 1 + doc_id % 3 + doc_id % 4 AS end_line,
         1 + doc_id % 5 AS start_col, 10 + doc_id % 20 AS end_col
  FROM documents)"""


def src_files(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n")
    return documents_text(spark, d).select(F.col("doc_id").alias("file"), parts.alias("lines"))


def src_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = documents_text(spark, d)
    return docs.select(F.col("doc_id").alias("file"),
                       F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n"))
                       .alias("pos", "line")).select("file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def spans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        k.alias("span_id"), k.alias("file"), (1 + k % 3).alias("start_line"),
        (1 + k % 3 + k % 4).alias("end_line"), (1 + k % 5).alias("start_col"), (10 + k % 20).alias("end_col"))


DB_LINES_SQL = """db_lines AS (
  SELECT p_size AS project, replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || ': main.o util.o' AS line
  FROM part
  UNION ALL SELECT p_size, '.PHONY: ' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR)
  FROM part WHERE p_type = 'PROMO'
  UNION ALL SELECT 1000 + p_size, t FROM part, (VALUES ('all: main.o'), ('.PHONY: all clean')) v(t) WHERE p_size > 40
  UNION ALL SELECT p_size, 'OPT:=-O2' FROM part
  UNION ALL SELECT DISTINCT p_size, 'Makefile: Makefile.in' FROM part)"""


def db_lines(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    tgt = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"))
    return (p.select(F.col("p_size").alias("project"), F.concat(tgt, F.lit(": main.o util.o")).alias("line"))
            .union(p.where(F.col("p_type") == "PROMO")
                   .select("p_size", F.concat(F.lit(".PHONY: "), tgt)))
            .union(p.where("p_size > 40").select(F.col("p_size") + 1000, F.explode(F.array(F.lit("all: main.o"), F.lit(".PHONY: all clean")))))
            .union(p.select("p_size", F.lit("OPT:=-O2")))
            .union(p.select("p_size", F.lit("Makefile: Makefile.in")).distinct()))


# ---------------------------------------------------------------- Z bytes
# Characters and UTF-8 bytes of every document, 0-based positions.
CHARS_SQL = """chs AS (SELECT doc_id, string_split(text, '') AS c FROM documents),
chars AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, c[i] AS symbol
          FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM chs))"""

BYTES_SQL = """hx AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
bytes AS (SELECT doc_id, n, CAST(i AS BIGINT) AS pos, CAST(('0x' || substring(h, 2 * i + 1, 2)) AS INTEGER) AS b
          FROM (SELECT doc_id, h, n, unnest(generate_series(0, n - 1)) AS i FROM hx))"""

KGRAM_SQL = """chs AS (SELECT doc_id, string_split(text, '') AS c FROM documents),
grams AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, c[i] || c[i + 1] || c[i + 2] AS gram
          FROM (SELECT doc_id, c, unnest(generate_series(1, len(c) - 2)) AS i FROM chs)),
matches AS (SELECT * FROM (
              SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id, gram ORDER BY pos) AS dist FROM grams)
            WHERE dist IS NOT NULL)"""


def documents_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents for per-document work: one scan of two columns."""
    return (table(spark, d, "documents").select("doc_id", "text"))


# ---------------------------------------------------------------- L lines
# Files are documents in doc_id order; sentence ends become a line plus two
# blank lines and ", " becomes a TAB, because the raw text has neither.
LINES_SQL = """files AS (
  SELECT doc_id AS file_ord,
         regexp_replace(replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), ', ', chr(9)),
                        '\\n\\z', '') AS body
  FROM documents),
fparts AS (SELECT file_ord, string_split(body, chr(10)) AS parts FROM files),
lines AS (SELECT file_ord, CAST(i - 1 AS BIGINT) AS idx, parts[i] AS line
          FROM (SELECT file_ord, parts, unnest(generate_series(1, len(parts))) AS i FROM fparts))"""


def line_files(spark: SparkSession, d: str) -> DataFrame:
    docs = documents_text(spark, d)
    content = F.replace(F.replace("text", F.lit(". "), F.lit(".\n\n\n")), F.lit(", "), F.lit("\t"))
    return docs.select(F.col("doc_id").alias("file_ord"), content.alias("content"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    from corvid.operators.lines import file_lines
    return file_lines(line_files(spark, d))


# ---------------------------------------------------------------- P images
# Pixels: lineitem grouped by (order, line number); image = order DIV 64,
# x = order mod 64, y = line number. Every third image is grey; alpha is
# opaque (image mod 4 = 0), binary (mod 4 = 1) or three-level; transparent
# pixels of images with image mod 8 = 1 are black (a key colour).
PIXELS_SQL = """px0 AS (
  SELECT l_orderkey // 64 AS image_id, CAST(l_orderkey % 64 AS INTEGER) AS x, l_linenumber AS y,
         min(l_partkey) AS pk, min(l_suppkey) AS sk
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
px1 AS (
  SELECT image_id, x, y,
         CAST(pk % 256 AS INTEGER) AS r0,
         CAST(CASE WHEN image_id % 3 = 0 THEN pk % 256 ELSE sk % 256 END AS INTEGER) AS g0,
         CAST(CASE image_id % 4 WHEN 0 THEN 255 WHEN 1 THEN CASE WHEN y % 3 = 0 THEN 0 ELSE 255 END
                   ELSE (y % 3) * 127 END AS INTEGER) AS a
  FROM px0),
pixels AS (
  SELECT image_id, x, y,
         CASE WHEN image_id % 8 = 1 AND a = 0 THEN 0 ELSE r0 END AS r,
         CASE WHEN image_id % 8 = 1 AND a = 0 THEN 0 ELSE g0 END AS g,
         CASE WHEN image_id % 8 = 1 AND a = 0 THEN 0 ELSE g0 END AS b,
         a
  FROM px1)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"))
    img = F.floor(F.col("l_orderkey") / 64).cast("bigint")
    p = g.select(img.alias("image_id"), (F.col("l_orderkey") % 64).cast("int").alias("x"),
                 F.col("l_linenumber").alias("y"), "pk", "sk")
    r0 = (F.col("pk") % 256).cast("int")
    g0 = F.when(F.col("image_id") % 3 == 0, F.col("pk") % 256).otherwise(F.col("sk") % 256).cast("int")
    i4 = F.col("image_id") % 4
    a = (F.when(i4 == 0, 255).when(i4 == 1, F.when(F.col("y") % 3 == 0, 0).otherwise(255))
         .otherwise((F.col("y") % 3) * 127)).cast("int")
    p = p.select("image_id", "x", "y", r0.alias("r0"), g0.alias("g0"), a.alias("a"))
    black = (F.col("image_id") % 8 == 1) & (F.col("a") == 0)
    return p.select("image_id", "x", "y", F.when(black, 0).otherwise(F.col("r0")).alias("r"),
                    F.when(black, 0).otherwise(F.col("g0")).alias("g"),
                    F.when(black, 0).otherwise(F.col("g0")).alias("b"), "a")


FILES_SQL = """files AS (
  SELECT 'img' || CAST(o_orderkey AS VARCHAR) || '.png' AS name,
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'out_' END || 'img' || CAST(o_orderkey AS VARCHAR) || '.png' AS out_name,
         CAST(floor(o_totalprice) AS BIGINT) AS in_size,
         CAST(floor(o_totalprice) AS BIGINT) - o_custkey % 997 + CASE WHEN o_orderkey % 5 = 0 THEN 2000 ELSE 0 END
           AS out_size,
         CASE WHEN o_orderkey % 7 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) - 500 END AS old_size,
         o_orderstatus = 'P' AS error
  FROM orders)"""


def image_files(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    ins = F.floor("o_totalprice").cast("bigint")
    return o.select(
        F.concat(F.lit("img"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("name"),
        F.concat(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("out_"), F.lit("img"), F.col("o_orderkey").cast("string"),
                 F.lit(".png")).alias("out_name"),
        ins.alias("in_size"),
        (ins - F.col("o_custkey") % 997 + F.when(F.col("o_orderkey") % 5 == 0, 2000).otherwise(0)).alias("out_size"),
        F.when(F.col("o_orderkey") % 7 == 0, ins - 500).alias("old_size"),
        (F.col("o_orderstatus") == "P").alias("error"))


CHUNK_NAMES = {"AO": "tEXt", "AF": "iTXt", "NO": "gAMA", "NF": "sRGB", "RO": "pHYs", "RF": "zTXt"}


def image_chunk_names(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    m = F.create_map(*[x for k, v in CHUNK_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return li.select(F.floor(F.col("l_orderkey") / 64).cast("bigint").alias("image_id"),
                     m[F.concat("l_returnflag", "l_linestatus")].alias("name"))
