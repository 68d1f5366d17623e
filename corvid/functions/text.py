"""Text column helpers shared by several areas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_ws(c: Column) -> Column:
    """Remove leading/trailing whitespace including newlines (Python's ``str.strip``)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def between_tags(text: Column, tag: str) -> Column:
    """Text from ``<TAG>\\n`` to ``</TAG>`` (or a second opening, or the end); '' when never opened."""
    return F.split_part(F.split_part(text, F.lit(f"<{tag}>\n"), F.lit(2)), F.lit(f"</{tag}>"), F.lit(1))


def has_tag(text: Column, tag: str) -> Column:
    return text.contains(f"<{tag}>\n")
