"""L area: line transforms of concatenated files (number, squeeze, visualise).

Lines are ``(file_ord, idx, line)``: ``file_ord`` orders files, ``idx`` is
the 0-based line index inside its file. Numbering continues across files:
per-file counts get an exclusive prefix sum in file order (a blocked scan,
one row per file), and the in-file rank is a window partitioned by file,
which is bounded by one file's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.bytes import byte_values
from corvid.plans.ordering import blocked_running_sum, small_join, stored, with_global_position

# Fixed values of the output format.
NUMBER_FORMAT = "%6d\t"
TAB_MARK = "^I"
END_MARK = "$"
CR_MARK = "^M"


def file_lines(files: DataFrame, content: str = "content", key: str = "file_ord") -> DataFrame:
    """Split each file's content into lines; an empty file has none. A final
    newline ends the last line (it does not start an empty one)."""
    body = F.regexp_replace(F.col(content), r"\n\z", "")
    parts = F.when(F.col(content) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))
    return (files.select(key, F.posexplode(parts).alias("idx", "line"))
            .withColumn("idx", F.col("idx").cast("bigint")))


def _file_offsets(per_file: DataFrame, value: str) -> DataFrame:
    """Exclusive prefix sum of ``value`` over files in ``file_ord`` order."""
    s = blocked_running_sum(per_file, [], "file_ord", F.col(value), "_incl")
    return s.select("file_ord", (F.col("_incl") - F.col(value)).alias("_offset"))


def squeeze_blank(lines: DataFrame) -> DataFrame:
    """L4: drop an empty line that follows an empty line, also across files.

    The line before a file's first line is the previous file's last line:
    files get a global position (files with lines only) and are joined to
    their predecessor on position, an equi join.
    """
    last = (lines.groupBy("file_ord").agg(F.max(F.struct("idx", "line")).alias("_l"))
            .select("file_ord", (F.col("_l.line") == "").alias("_last_blank")))
    pos = with_global_position(last, [F.col("file_ord")], "_p")
    prev = pos.select((F.col("_p") + 1).alias("_p"), F.col("_last_blank").alias("_prev_blank"))
    boundary = pos.join(prev, "_p", "left").select("file_ord", F.coalesce("_prev_blank", F.lit(False)).alias("_pb"))
    w = Window.partitionBy("file_ord").orderBy("idx")
    prev_line = F.lag("line").over(w)
    x = lines.join(boundary, "file_ord").withColumn(
        "_prev_blank", F.when(F.col("idx") == 0, F.col("_pb")).otherwise(prev_line == ""))
    return x.where(~((F.col("line") == "") & F.col("_prev_blank"))).drop("_pb", "_prev_blank")


def number_lines(lines: DataFrame, nonblank: bool = False, text: str = "line") -> DataFrame:
    """L2 (all lines) / L3 (``nonblank``: only non-empty lines get a number).

    Adds ``n`` (NULL for unnumbered blank lines under L3) and ``out``.
    """
    flag = (F.col(text) != "").cast("bigint") if nonblank else F.lit(1).cast("bigint")
    x = lines.withColumn("_f", flag)
    per_file = x.groupBy("file_ord").agg(F.sum("_f").alias("_cnt"))
    offs = _file_offsets(per_file, "_cnt")
    w = Window.partitionBy("file_ord").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(offs, "file_ord").withColumn("_rank", F.sum("_f").over(w))
    n = F.col("_offset") + F.col("_rank")
    numbered = F.concat(F.format_string(NUMBER_FORMAT, n), F.col(text))
    if nonblank:
        out = F.when(F.col("_f") == 1, numbered).otherwise(F.col(text))
        n = F.when(F.col("_f") == 1, n)
    else:
        out = numbered
    return x.withColumn("n", n).withColumn("out", out).drop("_f", "_offset", "_rank")


def show_ends(line: Column) -> Column:
    """``$`` at the end of each line; a CR right before the end shows as ``^M``."""
    return F.concat(F.regexp_replace(line, "\r$", CR_MARK), F.lit(END_MARK))


def show_tabs(line: Column) -> Column:
    """TAB shown as ``^I``."""
    return F.replace(line, F.lit("\t"), F.lit(TAB_MARK))


def _visible_byte(b: Column) -> Column:
    ch = F.call_function("chr", b)
    low = b.bitwiseAND(F.lit(127))
    low_ch = F.call_function("chr", low)
    low_ctrl = F.concat(F.lit("^"), F.call_function("chr", low + 64))
    plain = (F.when(low < 32, low_ctrl).when(low == 127, F.lit("^?")).otherwise(low_ch))
    return (F.when(b >= 128, F.concat(F.lit("M-"), plain))
            .when(b == 9, F.lit("\t"))
            .when(b < 32, F.concat(F.lit("^"), F.call_function("chr", b + 64)))
            .when(b == 127, F.lit("^?"))
            .otherwise(ch))


PRINTABLE_ASCII = r"^[\x20-\x7e\t]*\z"


def show_nonprinting(line: Column) -> Column:
    """Control bytes as ``^X``, DEL as ``^?``, bytes >= 128 as ``M-`` plus
    the rendering of the low 7 bits; TAB unchanged. Works on UTF-8 bytes.

    Lines of printable ASCII (the common case) pass through unchanged; only
    the others take the per-byte mapping.
    """
    mapped = F.array_join(F.transform(byte_values(F.encode(line, "UTF-8")), _visible_byte), "")
    return F.when(line.rlike(PRINTABLE_ASCII), line).otherwise(mapped)


def show_all(line: Column) -> Column:
    """``-A`` = non-printing, tabs and ends together."""
    return show_ends(show_tabs(show_nonprinting(line)))


# ------------------------------------------------------------ file-level forms
# When each file is one row (whole-file reads), per-file work happens inside
# the row and lines are exploded last. Two passes read the text: the first
# writes narrow facts (a few numbers a file), from which offsets follow; the
# second joins them to the file rows and numbers lines while exploding them.
def _body(content: Column) -> Column:
    """The content without the newline that ends its last line."""
    return F.when(content.endswith("\n"), F.substr(content, F.lit(1), F.length(content) - 1)).otherwise(content)


def _line_array(content: Column) -> Column:
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(_body(content), "\n"))


def _kept_by_squeeze(lines: Column, after_blank: Column) -> Column:
    """Indexes of the lines that stay when an empty line after an empty line
    goes; ``after_blank`` says whether the line before the first is empty."""
    at = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: (F.get(lines, i) != "") | F.when(i == 0, ~after_blank).otherwise(F.get(lines, i - 1) != ""))


def file_offsets(files: DataFrame, content: str = "content", key: str = "file_ord", nonblank: bool = False,
                 squeeze: bool = False) -> tuple[DataFrame, int]:
    """(key, _offset, _after_blank) and the number of files: how many numbered
    lines come before each file, and under ``squeeze`` whether it follows an
    empty line. Nothing but these facts is sorted or shuffled."""
    text, lines = F.col(content), F.col("_lines")
    if squeeze or nonblank:
        count = F.size(F.array_remove(lines, "")) if nonblank else F.size(_kept_by_squeeze(lines, F.lit(False)))
        facts = files.select(key, _line_array(text).alias("_lines")).select(
            key, count.cast("bigint").alias("_count"), (F.size(lines) > 0).alias("_any"),
            (F.get(lines, F.lit(0)) == "").alias("_first_blank"), (F.element_at(lines, -1) == "").alias("_last_blank"))
    else:
        body = _body(text)
        breaks = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
        facts = files.select(key, F.when(text == "", 0).otherwise(breaks + 1).cast("bigint").alias("_count"))
    facts = stored(facts, "line-facts")
    order, blank = key, F.lit(False)
    if squeeze:
        # the line before a file's first is the last of the file before it that has lines
        placed = with_global_position(facts.where("_any"), [F.col(key)], "_p")
        before = placed.select((F.col("_p") + 1).alias("_p"), F.col("_last_blank").alias("_after_blank"))
        facts = placed.join(before, "_p", "left").withColumn("_after_blank", F.coalesce("_after_blank", F.lit(False))).withColumn(
            "_count", F.col("_count") - (F.col("_first_blank") & F.col("_after_blank")).cast("bigint"))
        order, blank = "_p", F.col("_after_blank")
    running = blocked_running_sum(facts, [], order, F.col("_count"), "_to")
    return running.select(key, (F.col("_to") - F.col("_count")).alias("_offset"), blank.alias("_after_blank")), facts.count()


def number_files(files: DataFrame, content: str = "content", key: str = "file_ord", nonblank: bool = False,
                 squeeze: bool = False) -> DataFrame:
    """L2, L3 (``nonblank``: only non-empty lines get a number) or L4 and L2
    (``squeeze``) on file rows; returns ``(key, idx, line, n, out)``.

    Offsets are joined to the file rows: broadcast as long as they are few
    narrow rows, else as the planner chooses. Lines are exploded once.
    """
    if nonblank and squeeze:
        raise ValueError("lines are squeezed or numbered without blanks, not both")
    offsets, n_files = file_offsets(files, content, key, nonblank, squeeze)
    text, lines = F.col(content), F.col("_lines")
    x = small_join(files.select(key, content).where(text != ""), offsets, key, n_files)
    x = x.select(key, "_offset", "_after_blank", _line_array(text).alias("_lines"))
    if squeeze:
        kept = x.select(key, "_offset", "_lines", F.posexplode(_kept_by_squeeze(lines, F.col("_after_blank"))).alias("_rank", "idx"))
        rows = kept.select(key, F.col("idx").cast("bigint").alias("idx"), F.get(lines, F.col("idx")).alias("line"),
                           (F.col("_offset") + F.col("_rank") + 1).alias("n"))
    elif nonblank:
        at = F.sequence(F.lit(0), F.size(lines) - 1)
        ranked = F.transform(F.filter(at, lambda i: F.get(lines, i) != ""), lambda i, k: F.struct(
            i.alias("idx"), F.get(lines, i).alias("line"), k.alias("rank")))
        blanks = F.transform(F.filter(at, lambda i: F.get(lines, i) == ""), lambda i: F.struct(
            i.alias("idx"), F.lit("").alias("line"), F.lit(None).cast("int").alias("rank")))
        rows = x.select(key, "_offset", F.inline(F.concat(ranked, blanks))).select(
            key, F.col("idx").cast("bigint").alias("idx"), "line", (F.col("_offset") + F.col("rank") + 1).alias("n"))
    else:
        rows = x.select(key, "_offset", F.posexplode("_lines").alias("idx", "line")).select(
            key, F.col("idx").cast("bigint").alias("idx"), "line", (F.col("_offset") + F.col("idx") + 1).alias("n"))
    numbered = F.concat(F.format_string(NUMBER_FORMAT, "n"), F.col("line"))
    return rows.withColumn("out", F.when(F.col("n").isNull(), F.col("line")).otherwise(numbered) if nonblank else numbered)
