"""T area: operators over parsed call-trace records.

Input rows: ``(file, seq, name, args MAP<STRING,STRING>, ret ARRAY<STRING>)``
where ``seq`` orders the records of one log file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.trace_text import CUT_STEPS, ENTRY, REDACTED, RUN_MARKER, classify_value, cut_result, record_name
from corvid.plans.ordering import blocked_running_sum


def parse_records(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """T11 applied to a frame of raw records: (parsed, rejects)."""
    keep = [c for c in raw.columns if c != value]
    frame = raw.withColumnRenamed(value, "_raw").withColumn("_cut_record", F.col("_raw"))

    def get(name: str) -> Column:
        return F.col(f"_cut_{name}")

    for step in CUT_STEPS:
        frame = frame.withColumns({f"_cut_{name}": column for name, column in step(get).items()})
    # The parsed struct is produced by a generator (inline of a one-element
    # array): filters on its fields cannot be pushed below it, so each record
    # is parsed once instead of once per referenced field.
    p = frame.select(*keep, "_raw", F.inline(F.array(cut_result(get))))
    good = p.where("ok").select(*keep, "name", "args", "pos_args", "ret")
    bad = p.where(~F.col("ok")).select(*keep, F.col("_raw").alias("record"))
    return good, bad


def record_names(raw: DataFrame, value: str = "value") -> DataFrame:
    """The columns beside ``value`` and ``name`` of the records that have a
    name: all that runs need. Arguments are not looked at."""
    keep = [c for c in raw.columns if c != value]
    return raw.select(*keep, F.inline(F.array(F.struct(record_name(F.col(value)).alias("name"))))).where("name IS NOT NULL")


def redact_contents(trace: DataFrame) -> DataFrame:
    """T5: values that are pointed-to text become a fixed token; addresses and numbers stay."""
    return trace.withColumn("args", F.transform_values(
        "args", lambda k, v: F.when(classify_value(v) == "text", F.lit(REDACTED)).otherwise(v)))


def distinct_names(names: Column) -> Column:
    """Parameter names, each different from those before it: an empty or null
    one is ``_`` and its ordinal, a repeated one gets ``_`` and its ordinal."""
    empty = F.array().cast("array<string>")

    def add(done: Column, name: Column) -> Column:
        suffix = F.concat(F.lit("_"), (F.size(done) + 1).cast("string"))
        own = F.when(F.coalesce(name, F.lit("")) == "", suffix).otherwise(name)
        # at most size(done) repetitions of the suffix are taken
        tries = F.transform(F.sequence(F.lit(0), F.size(done)), lambda k: F.concat(own, F.repeat(suffix, k)))
        return F.concat(done, F.array(F.get(F.array_except(tries, done), 0)))

    return F.aggregate(names, empty, add)


def name_positional_args(trace: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give positional values parameter names from the inventory.

    ``inventory``: ``(name, param_names ARRAY, struct_return BOOLEAN)``, one row
    per name. A struct-returning function gets ``<return_val>`` as its first
    slot. A parameter without a name is ``_`` and its ordinal; a name that an
    earlier slot has already got is followed by ``_`` and its ordinal, as often
    as it takes to differ. Values beyond the parameters are dropped from the
    map and reported in the rejects frame ``(…, ordinal, value)``.
    """
    slots = F.when(F.coalesce("struct_return", F.lit(False)), F.concat(F.array(F.lit("<return_val>")), "param_names")).otherwise(
        F.col("param_names"))
    inv = inventory.select("name", distinct_names(slots).alias("_names"))
    j = trace.join(inv, "name", "left")
    names = F.coalesce("_names", F.array().cast("array<string>"))
    n = F.least(F.size("pos_args"), F.size(names))
    named = j.withColumn("args", F.when(n > 0, F.map_from_arrays(F.slice(names, 1, n), F.slice("pos_args", 1, n)))
                         .otherwise(F.create_map().cast("map<string,string>")))
    jn = j.withColumn("_np", F.size(names))
    extra = (jn.where(F.size("pos_args") > F.col("_np"))
             .select(*[c for c in trace.columns if c != "pos_args"], "_np",
                     F.posexplode(F.slice("pos_args", F.col("_np") + 1, F.size("pos_args"))).alias("_i", "value"))
             .withColumn("ordinal", F.col("_i") + F.col("_np") + 1).drop("_i", "_np"))
    return named.drop("_names"), extra


def calls_per_function(trace: DataFrame) -> DataFrame:
    """Number of records per function name."""
    return trace.groupBy("name").agg(F.count(F.lit(1)).alias("calls"))


def distinct_arguments(trace: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct values per (function, parameter). ``approx`` uses HyperLogLog++."""
    kv = trace.select("name", F.explode("args").alias("param", "value"))
    agg = F.approx_count_distinct("value") if approx else F.count_distinct("value")
    return kv.groupBy("name", "param").agg(agg.alias("distinct_values"), F.count(F.lit(1)).alias("calls"))


#: Registers of a sketch: 2^12, for a standard error of 1.04 / 2^6 (1.6 %).
SKETCH_LG = 12


def sketch_arguments(trace: DataFrame, period: str, lg_registers: int = SKETCH_LG) -> DataFrame:
    """T8, mergeable: one sketch of the values per (period, function,
    parameter), and the number of calls. A sketch has a bounded size, so
    periods can be stored and merged at any time."""
    kv = trace.select(period, "name", F.explode("args").alias("param", "value"))
    return kv.groupBy(period, "name", "param").agg(F.hll_sketch_agg("value", lg_registers).alias("sketch"),
                                                   F.count(F.lit(1)).alias("calls"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """(name, param, estimate, calls) over the periods of ``sketches``."""
    return sketches.groupBy("name", "param").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), F.sum("calls").alias("calls"))


def sketch_bounds(exact: Column, lg_registers: int = SKETCH_LG, errors: float = 4.0) -> tuple[Column, Column]:
    """Between which values an estimate of ``exact`` lies, within that many
    standard errors of a merged sketch (a whole value at least)."""
    off = F.greatest(F.lit(1.0), exact * (errors * 1.04 / 2 ** (lg_registers / 2)))
    return exact - off, exact + off


def split_runs(trace: DataFrame, marker: str = RUN_MARKER, block_size: int = 1 << 20) -> DataFrame:
    """Run number per record; a run starts at each ``marker`` record.

    Records before the first marker belong to run 0. The running count is
    the blocked scan, so a log file holding most records is still split
    into bounded window partitions.
    """
    flag = (F.col("name") == F.lit(marker)).cast("bigint")
    return blocked_running_sum(trace, ["file"], "seq", flag, "run", block_size)


def crashed_runs(runs: DataFrame, entry: str = ENTRY) -> DataFrame:
    """Runs without an entry-point record (records are written at return)."""
    return (runs.groupBy("file", "run")
            .agg(F.count(F.lit(1)).alias("records"),
                 F.bool_or(F.col("name") == F.lit(entry)).alias("has_main"),
                 F.min("seq").alias("first_seq"))
            .where(~F.col("has_main")))
