"""File sources and sinks for the reference's formats. Every reader has an
explicit schema (no inference); where producers add keys of their own, values
are read semi-structured and what the schema doesn't name comes back beside it."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.sources.blobs import plain_path, read_blobs  # noqa: F401  (Z1 is kept importable from here)
from corvid.sources.ordered_text import concat_files  # noqa: F401  (L1)

# ------------------------------------------------------------ schemas
# Fixed values of the file formats: column names and JSON keys.
SAMPLE_SCHEMA = T.StructType([T.StructField("func_name", T.StringType()),
                              T.StructField("length", T.IntegerType()),
                              T.StructField("result", T.StringType())])

FUNCTION_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("signature", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("startLine", T.IntegerType()), T.StructField("startCol", T.IntegerType()),
    T.StructField("endLine", T.IntegerType()), T.StructField("endCol", T.IntegerType()),
    T.StructField("calledFunctions", T.ArrayType(T.StringType())),
    T.StructField("num_args", T.IntegerType()), T.StructField("argTypes", T.ArrayType(T.StringType())),
    T.StructField("argNames", T.ArrayType(T.StringType())), T.StructField("returnType", T.StringType())])

DATASET_KEYS = {"description": "string", "code_dir": "string", "test_dir": "string", "setup_script": "string",
                "test_scripts": "array<string>"}

COMPILE_COMMAND_SCHEMA = T.StructType([T.StructField("directory", T.StringType()),
                                       T.StructField("file", T.StringType()),
                                       T.StructField("arguments", T.ArrayType(T.StringType()))])

RUN_LOG_KEYS = {"date": "string", "attempts": "int", "model": "string"}
RESULT_KEYS = {"function": "string", "results": "string"}
SAMPLE_RESULTS = ["Success", "Failure"]


# ------------------------------------------------------------ R1 scenarios
def scan_scenarios(spark: SparkSession, root: str) -> DataFrame:
    """Every ``category/taskN`` directory's README and prompt as one row.

    ``(category, task, readme, prompt, has_source)``; whole-file text reads,
    category and task from the path. Missing prompt/README stay NULL.
    """
    root = root.rstrip("/")
    txt = (spark.read.text([f"{root}/*/*/README.md", f"{root}/*/*/prompt.txt"], wholetext=True)
           .select(F.col("_metadata.file_path").alias("path"), "value"))
    parts = F.split(F.regexp_replace("path", r"^file:", ""), "/")
    n = F.size(parts)
    x = txt.select(F.element_at(parts, n - 2).alias("category"), F.element_at(parts, n - 1).alias("task"),
                   F.element_at(parts, n).alias("fname"), "value")
    rows = x.groupBy("category", "task").agg(
        F.max(F.when(F.col("fname") == "README.md", F.col("value"))).alias("readme"),
        F.max(F.when(F.col("fname") == "prompt.txt", F.col("value"))).alias("prompt"))
    # any file at any depth below source/ counts, a folder does not
    below = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(plain_path(F.col("_metadata.file_path")).alias("path"))
    inside = F.regexp_extract("path", r"([^/]+/[^/]+)/source/.", 1)
    top = F.split(inside, "/")
    has = (below.where(F.col("path").rlike(r"^" + re.escape(re.sub(r"^file:(//)?", "", root)) + r"/[^/]+/[^/]+/source/."))
           .select(F.get(top, 0).alias("category"), F.get(top, 1).alias("task")).distinct().withColumn("has_source", F.lit(True)))
    return rows.join(has, ["category", "task"], "left").withColumn("has_source", F.coalesce("has_source", F.lit(False)))


# ------------------------------------------------------------ B1 samples
def read_samples_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """B1 with a side table: (samples, rejects).

    Lines are parsed permissively. A line with a field too many or too few, a
    length that is no whole number, no name, or a result that is neither
    Success nor Failure is in no sample; ``rejects`` has it as it stands, with
    its file and the first reason that applies.
    """
    fields = [T.StructField("_raw", T.StringType())]
    raw = (spark.read.schema(T.StructType(SAMPLE_SCHEMA.fields + fields)).option("header", True).option("enforceSchema", True)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw")
           .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))
    reason = (F.when(F.col("_raw").isNotNull(), "malformed").when(F.coalesce("func_name", F.lit("")) == "", "no name")
              .when(F.col("length").isNull(), "no length").when(~F.coalesce(F.col("result").isin(SAMPLE_RESULTS), F.lit(False)), "no verdict"))
    x = raw.select(*SAMPLE_SCHEMA.fieldNames(), "_raw", F.col("_metadata.file_path").alias("file"), reason.alias("reason"))
    # a line that can be parsed is put together again for the report
    line = F.coalesce("_raw", F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SAMPLE_SCHEMA.fieldNames()]))
    good = x.where(F.col("reason").isNull()).select(*SAMPLE_SCHEMA.fieldNames())
    return good, x.where(F.col("reason").isNotNull()).select("file", line.alias("record"), "reason")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """B1: ``FuncName, Length, Result`` CSV with a blank after each comma; the
    rows that are samples."""
    return read_samples_checked(spark, path)[0]


# ------------------------------------------------------------ C1/C2 inventory
def read_functions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """JSON arrays of function records (multi-line), one file per project.

    ``calledFunctions`` stays NULL when absent (unknown), [] when empty.
    """
    df = spark.read.schema(FUNCTION_SCHEMA).option("multiLine", True).json(paths)
    return df.withColumn("project", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def write_functions(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Emit the inventory (JSON lines or parquet), partitioned by project
    when present. Overwriting replaces the projects that ``df`` holds and no
    others, so one project can be run again alone."""
    w = df.write.mode(mode)
    if "project" in df.columns:
        w = w.partitionBy("project").option("partitionOverwriteMode", "dynamic")
    w.format(fmt).save(path)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_functions`` wrote as JSON lines, with its ``project``."""
    schema = T.StructType(FUNCTION_SCHEMA.fields + [T.StructField("project", T.StringType())])
    return spark.read.schema(schema).json(path)


# ------------------------------------------------------------ X1-X3 configuration and logs
def known_and_other(value: Column, keys: dict[str, str]) -> list[Column]:
    """Columns of a JSON object read as VARIANT: each key of ``keys`` with its
    type (NULL where it is absent or of another type), and ``other``, a map of
    all further keys to their JSON text."""
    own = [F.try_variant_get(value, f"$.{k}", t).alias(k) for k, t in keys.items()]
    rest = F.map_filter(F.try_variant_get(value, "$", "map<string, variant>"), lambda k, _: ~k.isin(list(keys)))
    return [*own, F.transform_values(rest, lambda _, v: F.to_json(v)).alias("other")]


def read_datasets(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The dataset map exploded to rows ``(name, ..., other)``; an unknown
    ``name`` is an error. Keys that the format doesn't name are in ``other``."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    entries = raw.select(F.explode(F.try_variant_get("v", "$", "map<string, variant>")).alias("name", "d"))
    out = entries.select("name", *known_and_other(F.col("d"), DATASET_KEYS))
    if name is not None:
        out = out.where(F.col("name") == name)
        if out.isEmpty():
            raise KeyError(f"unknown dataset {name!r}")
    return out


def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of compile commands."""
    return spark.read.schema(COMPILE_COMMAND_SCHEMA).option("multiLine", True).json(path)


def read_run_logs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(date, attempts, model, other, results)``: one nested log JSON per
    file, or per line with ``lines``; text that is no JSON object gives no row.

    ``results`` may be empty; its items are (function, results, other). Keys
    that the format doesn't name come back as JSON text in ``other``.
    """
    text = spark.read.option("lineSep", "\n").text(path) if lines else spark.read.text(path, wholetext=True)
    logs = text.select(F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    items = F.transform(F.try_variant_get("v", "$.results", "array<variant>"), lambda x: F.struct(*known_and_other(x, RESULT_KEYS)))
    return logs.select(*known_and_other(F.col("v"), RUN_LOG_KEYS), items.alias("results")).withColumn(
        "other", F.map_filter("other", lambda k, _: k != "results"))


# ------------------------------------------------------------ Z2 table sinks
def write_compressed(df: DataFrame, path: str, codec: str = "gzip", fmt: str = "text",
                     mode: str = "overwrite") -> None:
    """Table sink with a compression codec (gzip / deflate / zstd / ...).
    ``gzip_members.write_gzip`` writes gzip files that several tasks can read."""
    df.write.mode(mode).option("compression", codec).format(fmt).save(path)
