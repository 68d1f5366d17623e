"""Column expressions over code-inventory fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entry point is renamed so it can live beside other mains.
ENTRY_NAME = "main"
ENTRY_RENAMED = "main_0"


def basename(path: Column | str) -> Column:
    """Last path component."""
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)


def rename_entry(name: Column | str) -> Column:
    """C4: ``main`` -> ``main_0``; other names unchanged."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c == F.lit(ENTRY_NAME), F.lit(ENTRY_RENAMED)).otherwise(c)


def unrename_entry(name: Column | str) -> Column:
    """``main_0`` in a list means ``main`` (used by the block list, X8)."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c == F.lit(ENTRY_RENAMED), F.lit(ENTRY_NAME)).otherwise(c)


def build_signature(ret: Column, name: Column, types: Column, names: Column) -> Column:
    """``ret name(t1 n1, t2)``; an unnamed parameter prints its type only."""
    params = F.transform(
        F.arrays_zip(types.alias("t"), names.alias("n")),
        lambda p: F.when(F.coalesce(p["n"], F.lit("")) == "", p["t"])
        .otherwise(F.concat(p["t"], F.lit(" "), p["n"])))
    return F.concat(ret, F.lit(" "), name, F.lit("("),
                    F.coalesce(F.array_join(params, ", "), F.lit("")), F.lit(")"))


def function_length(start_line: Column | str = "start_line", end_line: Column | str = "end_line") -> Column:
    """Inclusive line span."""
    s = F.col(start_line) if isinstance(start_line, str) else start_line
    e = F.col(end_line) if isinstance(end_line, str) else end_line
    return e - s + F.lit(1)
