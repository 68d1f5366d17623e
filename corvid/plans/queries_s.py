"""Source and sink queries: a table is written as files in the format of the
area, read back by the library's reader, and judged as rows."""

from pyspark.sql import functions as F

from corvid.operators import lines as L
from corvid.operators import translate as X
from corvid.plans import views
from corvid.plans.catalog import register
from corvid.plans.ordering import with_global_position
from corvid.session import shared_path
from corvid.sources import blobs, files, gzip_members, ordered_text
from corvid.sources.tables import table


# ---------------------------------------------------------------- B1 samples
# Samples as CSV; of a toxic document the length is words, of a toxic one of
# low quality a field is missing.
_CSV_SQL = """csv AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS func_name, n_chars AS length, l.toxic = 1 AS bad, l.quality = 1 AS good,
         CASE WHEN l.quality = 1 THEN 'Success' ELSE 'Failure' END AS result
  FROM documents JOIN labels l USING (doc_id))"""


def _sample_files(spark, d):
    path = shared_path(spark, "samples")
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    bad, name = F.col("toxic") == 1, F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    result = F.when(F.col("quality") == 1, "Success").otherwise("Failure")
    line = (F.when(bad & (F.col("quality") == 1), F.concat(name, F.lit(", many, "), result))
            .when(bad, F.concat(name, F.lit(", "), F.col("n_chars").cast("string")))
            .otherwise(F.concat(name, F.lit(", "), F.col("n_chars").cast("string"), F.lit(", "), result)))
    # one column in CSV form; its name is the header line
    j.select(line.alias("FuncName, Length, Result")).write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    return path


@register("b1_read_samples", "B", oracle=f"""
WITH {_CSV_SQL} SELECT func_name, CAST(length AS INTEGER) AS length, result FROM csv WHERE NOT bad""")
def b1(spark, d):
    return files.read_samples(spark, _sample_files(spark, d))


@register("b1_sample_rejects", "B", oracle=f"""
WITH {_CSV_SQL}
SELECT CASE WHEN good THEN func_name || ', many, ' || result ELSE func_name || ', ' || CAST(length AS VARCHAR) END AS record,
       'malformed' AS reason FROM csv WHERE bad""")
def b1_rejects(spark, d):
    return files.read_samples_checked(spark, _sample_files(spark, d))[1].select("record", "reason")


# ---------------------------------------------------------------- C1, C2 inventory
_INVENTORY_SQL = f"""WITH {views.FUNCTIONS_SQL}
SELECT name, filename, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, c_nationkey AS project,
       CASE WHEN c_nationkey = 3 THEN 'second' ELSE 'first' END AS signature,
       CASE WHEN c_nationkey = 3 THEN NULL ELSE 1 END AS callees
FROM functions JOIN (SELECT c_custkey, c_nationkey FROM customer) USING (c_custkey)"""


def _inventory(spark, d):
    f = views.functions(spark, d)
    return f.select("name", "filename", F.col("start_line").cast("int").alias("startLine"), F.col("end_line").cast("int").alias("endLine"),
                    F.array("return_type").alias("calledFunctions"), F.lit("first").alias("signature"),
                    F.regexp_extract("filename", "m([0-9]+)", 1).alias("project"))


def _inventory_rows(f):
    return f.select("name", "filename", F.col("startLine").alias("start_line"), F.col("endLine").alias("end_line"),
                    F.col("project").cast("int").alias("project"), "signature",
                    F.when(F.col("calledFunctions").isNotNull(), F.size("calledFunctions")).alias("callees"))


@register("c2_write_functions", "C", oracle=_INVENTORY_SQL)
def c2(spark, d):
    """All projects are written, then one of them again: its rows are replaced
    (callees are unknown now), all others stay."""
    path = shared_path(spark, "inventory")
    inv = _inventory(spark, d)
    files.write_functions(inv, path)
    again = inv.where("project = '3'").withColumns({"signature": F.lit("second"), "calledFunctions": F.lit(None).cast("array<string>")})
    files.write_functions(again, path)
    return _inventory_rows(files.read_inventory(spark, path))


@register("c1_read_functions", "C", oracle=_INVENTORY_SQL.replace("WHEN c_nationkey = 3 THEN 'second' ", "WHEN false THEN '' ").replace(
    "WHEN c_nationkey = 3 THEN NULL", "WHEN false THEN NULL"))
def c1(spark, d):
    """One JSON array per source file of a project, as the inventory tool writes them."""
    inv = _inventory(spark, d)
    rows = inv.withColumn("file", F.concat(F.lit("p"), "project", F.lit("/"), F.floor(F.col("startLine") / 100).cast("string"), F.lit(".json")))
    arrays = rows.groupBy("file").agg(F.to_json(F.collect_list(F.struct(*[c for c in inv.columns if c != "project"]))).alias("content"))
    path = shared_path(spark, "inventories")
    blobs.write_files(arrays, path, "file")
    f = files.read_functions(spark, f"{path}/*/*.json")
    return _inventory_rows(f.withColumn("project", F.regexp_extract("project", "p([0-9]+)", 1)))


# ---------------------------------------------------------------- X1-X3
@register("x1_read_datasets", "X", oracle="""
SELECT s_name AS name, 'src/' || CAST(s_nationkey AS VARCHAR) AS code_dir, CAST(2 AS INTEGER) AS n_tests,
       CAST(s_nationkey AS VARCHAR) AS nation, CASE WHEN s_acctbal < 0 THEN '["overdrawn"]' END AS flags
FROM supplier""")
def x1(spark, d):
    """A map of datasets whose entries have keys of their own (nation, flags)."""
    s = table(spark, d, "supplier")
    entry = F.struct(F.concat(F.lit("src/"), F.col("s_nationkey").cast("string")).alias("code_dir"),
                     F.array(F.lit("a.sh"), F.lit("b.sh")).alias("test_scripts"), F.col("s_nationkey").alias("nation"),
                     F.when(F.col("s_acctbal") < 0, F.array(F.lit("overdrawn"))).alias("flags"))
    # a map file per nation
    maps = s.groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("s_name", entry))).alias("m"))
    path = shared_path(spark, "datasets")
    blobs.write_files(maps.select(F.format_string("%d.json", "s_nationkey").alias("path"), F.to_json("m").alias("content")), path)
    t = files.read_datasets(spark, path)
    return t.select("name", "code_dir", F.size("test_scripts").alias("n_tests"), F.col("other")["nation"].alias("nation"),
                    F.col("other")["flags"].alias("flags"))


@register("x2_read_compile_commands", "X", oracle="""
SELECT '/w/' || CAST(p_size AS VARCHAR) AS directory, 'part' || CAST(p_partkey AS VARCHAR) || '.c' AS file,
       '-I' || p_brand AS include_dir, CAST(3 AS INTEGER) AS n_arguments FROM part""")
def x2(spark, d):
    """One JSON array of commands per project."""
    p = table(spark, d, "part")
    command = F.struct(F.format_string("/w/%d", "p_size").alias("directory"), F.format_string("part%d.c", "p_partkey").alias("file"),
                       F.array(F.lit("cc"), F.concat(F.lit("-I"), "p_brand"), F.lit("-c")).alias("arguments"))
    arrays = p.groupBy("p_size").agg(F.to_json(F.collect_list(command)).alias("content"))
    path = shared_path(spark, "commands")
    blobs.write_files(arrays.withColumn("path", F.format_string("%d/compile_commands.json", "p_size")), path)
    c = files.read_compile_commands(spark, f"{path}/*/compile_commands.json")
    return c.select("directory", "file", F.get("arguments", F.lit(1)).alias("include_dir"), F.size("arguments").alias("n_arguments"))


@register("x3_read_run_logs", "X", oracle=f"""
WITH {views.ATTEMPTS_SQL},
outcomes AS (
  SELECT func, okey, CASE WHEN bool_or(success) THEN 'Success' ELSE arg_max(category, attempt) END AS result
  FROM attempts GROUP BY func, okey)
SELECT CASE okey % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' ELSE 'model-c' END AS model,
       CAST(okey // 100 % 7 AS VARCHAR) AS seed, result, count(*) AS functions
FROM outcomes GROUP BY ALL""")
def x3(spark, d):
    """Run logs of the attempts, a log a line, with keys that the format does
    not name (seed, host), read back and summed up by X12."""
    a = views.attempts(spark, d)
    out = X.attempt_outcomes(a).join(a.select("func", "okey").distinct(), "func")
    models = F.array(*[F.lit(m) for m in views.MODELS])
    logs = (out.withColumn("model", F.element_at(models, (F.col("okey") % 3 + 1).cast("int")))
            .groupBy("model", F.floor(F.col("okey") / 100).alias("batch"))
            .agg(F.collect_list(F.struct(F.col("func").alias("function"), F.col("result").alias("results"))).alias("results")))
    log = F.to_json(F.struct(F.lit("2024-01-01").alias("date"), F.lit(2).alias("attempts"), "model", "results",
                             (F.col("batch") % 7).alias("seed"), F.struct(F.lit("h").alias("name")).alias("host")))
    path = shared_path(spark, "run-logs")
    logs.select(log.alias("value")).write.text(path)
    back = files.read_run_logs(spark, path, lines=True).withColumn("seed", F.col("other")["seed"])
    return X.result_summary(back, ["model", "seed"])


# ---------------------------------------------------------------- Z1, Z2
@register("z1_read_blobs", "Z", oracle="""
SELECT 'page' || CAST(page_id AS VARCHAR) || '.html' AS name, octet_length(encode(html)) AS length, md5(html) AS md5, NULL AS error
FROM pages UNION ALL SELECT 'gone.html', NULL, NULL, 'FileNotFoundError'""")
def z1(spark, d):
    """Pages as files, one more path listed that isn't there."""
    root = shared_path(spark, "pages")
    name = F.format_string("page%d.html", "page_id")
    pages = table(spark, d, "pages").select(F.concat(F.lit("web/"), name).alias("path"), F.encode("html", "UTF-8").alias("content"))
    blobs.write_files(pages, root)
    listed = pages.select(F.concat(F.lit(f"{root}/"), "path").alias("path")).union(
        spark.createDataFrame([(f"{root}/web/gone.html",)], "path string"))
    b = blobs.read_listed_blobs(spark, blobs.write_manifest(listed, shared_path(spark, "manifest")))
    return b.select(F.substring_index("path", "/", -1).alias("name"), "length", F.md5("content").alias("md5"), "error")


@register("z2_write_compressed", "Z", oracle="""
WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT line, count(*) AS n, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS plain FROM l GROUP BY line""")
def z2(spark, d):
    """Texts as lines of gzip files of many members, read back by several tasks a file."""
    path = shared_path(spark, "gzip")
    gzip_members.write_gzip(views.documents_text(spark, d), path, "text", member_bytes=1 << 16, file_bytes=1 << 22)
    back = gzip_members.read_gzip(spark, path, split_bytes=1 << 18)
    return back.groupBy(F.col("value").alias("line")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).cast("bigint").alias("plain"))


@register("z2_member_index", "Z", oracle="""
WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT count(*) AS lines, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS plain, true AS smaller FROM l""")
def z2_index(spark, d):
    """What the member indexes say of all files together."""
    path = shared_path(spark, "gzip")
    gzip_members.write_gzip(views.documents_text(spark, d), path, "text", member_bytes=1 << 16, file_bytes=1 << 22)
    i = gzip_members.member_index(spark, path)
    return i.agg(F.sum("lines").alias("lines"), F.sum("plain").alias("plain"), (F.sum("packed") < F.sum("plain")).alias("smaller"))


# ---------------------------------------------------------------- L1
@register("l1_concat_files", "L", oracle="""
WITH l AS (SELECT coalesce(source, '') AS source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
SELECT source, row_number() OVER (ORDER BY source DESC, doc_id, i) AS n, line,
       printf('%6d', row_number() OVER (ORDER BY source DESC, doc_id, i)) || chr(9) || line AS out FROM l""")
def l1(spark, d):
    """Documents written as files, several a source in order of their ids, read
    with the sources in falling order and numbered through."""
    root = shared_path(spark, "texts")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("s_"), F.coalesce("source", F.lit(""))).alias("source"),
                                               F.coalesce("text", F.lit("")).alias("value"))
    piece = F.format_string("%08d", F.spark_partition_id())
    (docs.repartitionByRange(48, "source", "doc_id").sortWithinPartitions("source", "doc_id")
     .select("source", piece.alias("piece"), "value").write.partitionBy("source", "piece").text(root))
    source = F.regexp_extract("path", "source=s_([^/]*)", 1)
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        blobs.plain_path(F.col("_metadata.file_path")).alias("path"))
    order = with_global_position(paths, [source.desc(), F.col("path").asc()], "file_ord")
    rows = ordered_text.numbered_lines(spark, root, order)
    out = F.concat(F.format_string(L.NUMBER_FORMAT, "n"), "line")
    return rows.select(source.alias("source"), "n", "line", out.alias("out"))


# ---------------------------------------------------------------- R1
@register("r1_scan_scenarios", "R", oracle="""
SELECT 'c' || CAST(n_regionkey AS VARCHAR) AS category, 'task' || CAST(n_nationkey AS VARCHAR) AS task,
       n_name AS readme, CASE WHEN n_nationkey % 2 = 0 THEN 'do ' || n_name END AS prompt, n_nationkey % 3 = 0 AS has_source
FROM nation""")
def r1(spark, d):
    """Scenario folders: all have a README, some a prompt, some a source tree
    with files in its folders only, some a source folder elsewhere."""
    root = shared_path(spark, "scenarios")
    n = table(spark, d, "nation")
    at, k = F.format_string("c%d/task%d", "n_regionkey", "n_nationkey"), F.col("n_nationkey")
    found = F.array(F.struct(F.concat(at, F.lit("/README.md")).alias("path"), F.col("n_name").alias("content")),
                    F.when(k % 2 == 0, F.struct(F.concat(at, F.lit("/prompt.txt")).alias("path"), F.concat(F.lit("do "), "n_name").alias("content"))),
                    F.when(k % 3 == 0, F.struct(F.concat(at, F.lit("/source/a/b/main.c")).alias("path"), F.lit("int x;").alias("content")))
                    .otherwise(F.struct(F.concat(at, F.lit("/old/source/main.c")).alias("path"), F.lit("int y;").alias("content"))))
    blobs.write_files(n.select(F.inline(F.array_compact(found))), root)
    return files.scan_scenarios(spark, root)
