"""R area: scenario runs, the task x agent grid, outcomes and rubric scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Run directory naming used by the scenario driver.
RUN_PREFIX = "run_"
RUN_TIME_FORMAT = "yyyyMMdd_HHmmss"
RUN_NAME_PATTERN = r"^run_(.+)_([0-9]{8}_[0-9]{6})$"
ERROR_LOG_PREFIX = "error_log_"
ERROR_LOG_SUFFIX = ".txt"
# Rubric line: "- criterion: points" where points may carry a trailing '*'.
RUBRIC_LINE_PATTERN = r"^- (.*): ([0-9]+)\*?\s*$"
RUBRIC_SECTION_PATTERN = r"^([A-Za-z][A-Za-z ]*):\s*$"


def format_run_name(agent: F.Column, started_at: F.Column) -> F.Column:
    """Inverse of R2: ``run_{agent}_{yyyyMMdd_HHmmss}``."""
    return F.concat(F.lit(RUN_PREFIX), agent, F.lit("_"), F.date_format(started_at, RUN_TIME_FORMAT))


def parse_run_name(name: F.Column) -> F.Column:
    """R2: struct(agent, started_at) out of a run directory name; NULLs if it does not match."""
    ok = name.rlike(RUN_NAME_PATTERN)
    agent = F.regexp_extract(name, RUN_NAME_PATTERN, 1)
    stamp = F.regexp_extract(name, RUN_NAME_PATTERN, 2)
    return F.when(ok, F.struct(agent.alias("agent"),
                               F.try_to_timestamp(stamp, F.lit(RUN_TIME_FORMAT)).alias("started_at")))


def run_outcome(runs: DataFrame) -> DataFrame:
    """A non-zero return code marks the run failed and names its error log."""
    failed = F.col("return_code") != 0
    return runs.withColumns({
        "outcome": F.when(failed, "failed").otherwise("succeeded"),
        "error_log": F.when(failed, F.concat(F.lit(ERROR_LOG_PREFIX), F.col("run_name"),
                                             F.lit(ERROR_LOG_SUFFIX))),
    })


def write_outcomes(outcomes: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """R3 sink: run outcomes partitioned by ``outcome``, so failed runs (with
    their error-log names) land in their own folder."""
    outcomes.write.mode(mode).partitionBy("outcome").format(fmt).save(path)


def run_grid(tasks: DataFrame, agents: Sequence[str]) -> DataFrame:
    """Every task paired with every configured agent.

    The agent list is configuration (bounded by its literal size), so the
    pairing is a per-row ``explode`` of a literal array: no join, no shuffle.
    """
    if not agents:
        raise ValueError("at least one agent is required")
    return tasks.withColumn("agent", F.explode(F.array(*[F.lit(a) for a in agents])))


def pending_runs(grid: DataFrame, runs: DataFrame, keys: Sequence[str] = ("category", "task")) -> DataFrame:
    """Grid pairs with no run directory ``run_{agent}_*`` (any timestamp).
    Task names repeat across categories, so both are the key.

    Run names are parsed (R2) into an equi key, so this is a hash anti join,
    not a LIKE scan; the runs side is projected to distinct keys first.
    """
    done = (runs.select(*keys, parse_run_name(F.col("run_name")).agent.alias("agent"))
            .where(F.col("agent").isNotNull())
            .distinct())
    return grid.join(done, [*keys, "agent"], "left_anti")


def manifest_check(declared: DataFrame, actual: DataFrame, key: str = "category") -> DataFrame:
    """Declared task counts vs listed tasks per category (full outer)."""
    d = declared.select(key, F.col("n").alias("declared"))
    a = actual.select(key, F.col("n").alias("actual"))
    j = d.join(a, key, "full_outer")
    return j.select(key,
                    F.coalesce("declared", F.lit(0).cast("bigint")).alias("declared"),
                    F.coalesce("actual", F.lit(0).cast("bigint")).alias("actual"),
                    F.when(F.coalesce("declared", F.lit(0)) == F.coalesce("actual", F.lit(0)), "ok")
                    .otherwise("mismatch").alias("status"))


def score_rollup(rubric: DataFrame) -> DataFrame:
    """Points (and awarded points) per section, task, category and total.

    ``level`` is ``grouping_id`` of (category, task, section): 0 = section
    rows, 1 = task totals, 3 = category totals, 7 = grand total.
    """
    return (rubric.rollup("category", "task", "section")
            .agg(F.grouping_id().cast("int").alias("level"),
                 F.sum("points").cast("bigint").alias("points"),
                 F.sum("awarded").cast("bigint").alias("awarded")))


def rubric_total_check(rubric: DataFrame, expected: int = 20) -> DataFrame:
    """Tasks whose rubric points do not add up to ``expected``."""
    return (rubric.groupBy("category", "task")
            .agg(F.sum("points").cast("bigint").alias("total"))
            .where(F.col("total") != expected))


def token_cost(chats: DataFrame, prices: Mapping[str, float], by: Sequence[str] = ("model", "role"),
               chars_per_token: int = 4) -> DataFrame:
    """Approximate tokens (``ceil(chars / 4)``, our own rule) and cost.

    Prices are USD per million tokens from a small configuration mapping,
    applied as a literal map lookup after the aggregate (no join).
    """
    price_map = F.create_map(*[x for k, v in prices.items() for x in (F.lit(k), F.lit(float(v)))])
    tokens = F.ceil(F.length("text") / F.lit(chars_per_token)).cast("bigint")
    agg = chats.groupBy(*by).agg(F.count(F.lit(1)).alias("n_messages"),
                                 F.sum(tokens).cast("bigint").alias("tokens"))
    return agg.withColumn("cost", F.round(F.col("tokens") * price_map[F.col("model")] / F.lit(1e6), 6))


def parse_rubric(readmes: DataFrame, key: Sequence[str] = ("category", "task"),
                 text_col: str = "readme") -> DataFrame:
    """Rubric rows ``(section, ordinal, criterion, points)`` out of README text.

    A heading line ``Name:`` applies to the rubric lines below it until the
    next heading. The window is per file, so its size is bounded by one
    file's text, which already sits in one row. Only headings and rubric lines
    are sorted for it.
    """
    lines = readmes.select(*key, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", "\r$", ""))
    heading = F.when(F.col("line").rlike(RUBRIC_SECTION_PATTERN),
                     F.regexp_extract("line", RUBRIC_SECTION_PATTERN, 1))
    item = F.col("line").rlike(RUBRIC_LINE_PATTERN)
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.where(heading.isNotNull() | item).withColumn("section", F.last(heading, ignorenulls=True).over(w))
    items = lines.where(item & F.col("section").isNotNull())
    w2 = Window.partitionBy(*key).orderBy("pos")
    return items.select(*key, "section",
                        F.row_number().over(w2).alias("ordinal"),
                        F.regexp_extract("line", RUBRIC_LINE_PATTERN, 1).alias("criterion"),
                        F.regexp_extract("line", RUBRIC_LINE_PATTERN, 2).cast("int").alias("points"))
