"""C area: function inventory records, callee sets and unit merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions.code import basename

def definitions_only(records: DataFrame) -> DataFrame:
    """Keep records with a valid location, outside system headers, that define a body."""
    return records.where(F.col("is_valid_location") & ~F.col("is_system") & F.col("is_definition"))


def callee_set(edges: DataFrame, caller_cols: Sequence[str] = ("caller",), callee: str = "callee") -> DataFrame:
    """C11: sorted distinct callees per caller.

    ``collect_set`` deduplicates in the map-side partial aggregate, so each
    shuffle row carries at most one copy of a (caller, callee) pair and the
    final array is bounded by the caller's out-degree.
    """
    return (edges.groupBy(*caller_cols)
            .agg(F.array_sort(F.collect_set(callee)).alias("callees")))


def attach_callees(functions: DataFrame, callee_sets: DataFrame) -> DataFrame:
    """Attach the callee set matching on name and file base name.

    A record may match sets from several directories with the same base
    name; the first by caller path wins (explicit order instead of the
    reference's unordered-set iteration). Unmatched records keep NULL.
    "First" is a ``min(struct(path, callees))`` aggregate over the sets, which
    combines map-side; the records themselves are only joined, so equal ones
    all stay.
    """
    sets = (callee_sets.groupBy(F.col("caller").alias("_c_name"), basename("caller_path").alias("_c_base"))
            .agg(F.min(F.struct("caller_path", "callees")).alias("_m")))
    f = functions.withColumn("_base", basename("filename"))
    j = f.join(sets, (f["name"] == sets["_c_name"]) & (f["_base"] == sets["_c_base"]), "left")
    return j.select(*functions.columns, F.col("_m.callees").alias("callees"))


def defined_callees(edges: DataFrame, defs: DataFrame, callee: str = "callee") -> DataFrame:
    """Drop call edges whose callee is only declared (no definition record)."""
    names = defs.select(F.col("name").alias(callee)).distinct()
    return edges.join(names, callee, "left_semi")


def merge_units(*units: DataFrame) -> DataFrame:
    """Union of per-translation-unit record sets with whole-record set semantics."""
    if not units:
        raise ValueError("no units")
    out = units[0]
    for u in units[1:]:
        out = out.unionByName(u)
    return out.dropDuplicates()


def first_record_per_name(records: DataFrame, order: Sequence[str] = ("filename", "start_line", "end_line",
                                                                      "start_col", "end_col")) -> DataFrame:
    """When names repeat, the first record (explicit order) wins.

    ``min(struct(order..., rest...))`` per name: a partial aggregate, so a
    name shared by a third of all records still combines map-side.
    """
    rest = [c for c in records.columns if c not in order and c != "name"]
    first = F.min(F.struct(*order, *rest)).alias("_m")
    return records.groupBy("name").agg(first).select("name", *[F.col(f"_m.{c}").alias(c) for c in (*order, *rest)])
