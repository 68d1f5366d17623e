"""Z area: histograms, entropy, back-references, runs and chunks over text and bytes.

Row explosion is the cost driver here (one row per symbol): every job
projects the key and the symbol column only, aggregates with a map-side
partial aggregate before the shuffle, and keeps per-document work inside
window partitions keyed by the document (bounded by one row's text).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.bytes import MIN_MATCH, character, characters

NEAR_ZERO = -1e-5


def symbol_histogram(df: DataFrame, key: Sequence[str], symbols: Column) -> DataFrame:
    """Z3: count per symbol per group (partial + final hash aggregate)."""
    return (df.select(*key, F.explode(symbols).alias("symbol"))
            .groupBy(*key, "symbol").agg(F.count(F.lit(1)).alias("count")))


HISTOGRAM_TYPE = "struct<symbol: array<int>, count: array<bigint>>"


def code_histogram_in_row(text: Column) -> Column:
    """Z3 inside the row: struct(symbol[], count[]) of the code points of a text
    that occur; only distinct symbols leave the row."""
    @F.pandas_udf(HISTOGRAM_TYPE)
    def histogram(s: pd.Series) -> pd.DataFrame:
        out = [_counts(np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)) for t in s]
        return pd.DataFrame({"symbol": [o[0] for o in out], "count": [o[1] for o in out]})
    return histogram(text)


def byte_histogram_in_row(blob: Column) -> Column:
    """Z3 inside the row over the bytes of a BINARY, all 256 with their counts."""
    @F.pandas_udf(HISTOGRAM_TYPE)
    def histogram(s: pd.Series) -> pd.DataFrame:
        axis = np.arange(256, dtype=np.int32)
        out = [np.bincount(np.frombuffer(b or b"", np.uint8), minlength=256) for b in s]
        return pd.DataFrame({"symbol": [axis] * len(out), "count": out})
    return histogram(blob)


def _counts(codes):
    """(distinct codes, how often) by counting where codes are small."""
    if len(codes) and int(codes.max()) < 1 << 16:
        times = np.bincount(codes)
        found = np.flatnonzero(times)
        return found.astype(np.int32), times[found]
    found, times = np.unique(codes, return_counts=True)
    return found.astype(np.int32), times


def text_histogram(df: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Z3 over texts: (key..., symbol, count) of their characters, counted in
    each row before rows of a key are added up."""
    rows = explode_struct_arrays(df.select(*key, code_histogram_in_row(F.col(text)).alias("_h")), key, "_h", ["symbol", "count"])
    sums = rows.groupBy(*key, "symbol").agg(F.sum("count").alias("count"))
    return sums.withColumn("symbol", character(F.col("symbol")))


def entropy_bits(hist: DataFrame, key: Sequence[str], alphabet_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Bits per symbol ``log2(total) - log2(count)`` and the group total.

    A zero count costs ``log2(total)``; an empty group costs ``log2(n)`` per
    symbol (n = alphabet size); values in (-1e-5, 0) are clamped to 0.
    Returns (per-symbol bits, per-group ``sum(count * bits)``).
    """
    if not key:
        raise ValueError("entropy needs a group key (add a constant column for one group)")
    # a window holds one row a symbol of the alphabet
    over = Window.partitionBy(*key)
    h = hist.withColumns({"_sum": F.sum("count").over(over), "_n": F.count(F.lit(1)).over(over)})
    n = F.lit(float(alphabet_size)) if alphabet_size else F.col("_n").cast("double")
    raw = (F.when(F.col("_sum") == 0, F.log2(n))
           .when(F.col("count") == 0, F.log2(F.col("_sum")))
           .otherwise(F.log2(F.col("_sum")) - F.log2(F.col("count"))))
    bits = F.when((raw > NEAR_ZERO) & (raw < 0), F.lit(0.0)).otherwise(raw)
    per = h.withColumn("bits", bits).drop("_sum", "_n")
    total = per.groupBy(*key).agg(F.sum(F.col("count") * F.col("bits")).alias("total_bits"))
    return per, total


def merge_histograms(h1: DataFrame, w1: float, h2: DataFrame, w2: float, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Weighted sum of two histograms, truncated to an integer."""
    a = h1.select(*key, F.col("count").alias("_c1"))
    b = h2.select(*key, F.col("count").alias("_c2"))
    j = a.join(b, list(key), "full_outer")
    v = F.coalesce("_c1", F.lit(0)) * F.lit(float(w1)) + F.coalesce("_c2", F.lit(0)) * F.lit(float(w2))
    return j.select(*key, v.cast("bigint").alias("count"))


def pick_smallest(variants: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per item the variant with fewest bytes; ties go to the earlier ordinal.

    Variants with ``auto = false`` (brute force) are not candidates. The
    winner is ``min(struct(size, ordinal, name))``: a total order, combined
    map-side.
    """
    v = variants.where(F.coalesce(F.col("auto"), F.lit(True))) if "auto" in variants.columns else variants
    m = F.min(F.struct("size", "ordinal", "name")).alias("_m")
    return v.groupBy(*key).agg(m).select(*key, "_m.name", "_m.size", "_m.ordinal")


def pick_smallest_in_row(variants: Sequence[tuple[int, str, Column]]) -> Column:
    """Z6 for variants of one row: struct(size, ordinal, name) of the smallest,
    ties to the earlier ordinal. No shuffle; the row's text is read once."""
    return F.array_min(F.array(*[F.struct(size.cast("bigint").alias("size"), F.lit(o).alias("ordinal"), F.lit(n).alias("name"))
                                 for o, n, size in variants]))


def kgrams(df: DataFrame, key: Sequence[str], text: Column, k: int = MIN_MATCH) -> DataFrame:
    """(key..., pos, gram) for every position with k characters ahead.

    Built from the character array (constant-time element access), never
    from repeated substrings.
    """
    ch = df.select(*key, characters(text).alias("_ch"))
    idx = F.sequence(F.lit(0), F.size("_ch") - k)
    grams = F.transform(idx, lambda i: F.concat(*[F.element_at("_ch", i + 1 + j) for j in range(k)]))
    return (ch.where(F.size("_ch") >= k)
            .select(*key, F.posexplode(grams).alias("pos", "gram")))


def previous_occurrence(grams: DataFrame, key: Sequence[str], window: int | None = None) -> DataFrame:
    """Distance to the nearest previous equal k-gram (below ``window``
    where one is given).

    ``lag`` over (document, gram) ordered by position: one shuffle keyed by
    (document, gram); a partition holds one gram of one document.
    """
    w = Window.partitionBy(*key, "gram").orderBy("pos")
    d = grams.withColumn("dist", F.col("pos") - F.lag("pos").over(w)).where(F.col("dist").isNotNull())
    return d if window is None else d.where(F.col("dist") < window)


def repeated_spans(matches: DataFrame, key: Sequence[str], k: int = MIN_MATCH,
                   max_len: int | None = None) -> DataFrame:
    """Back-reference spans from runs of consecutive positions with equal distance.

    Gaps and islands: ``pos - row_number()`` is constant along a run. A run
    of r grams covers r + k - 1 characters; with ``max_len`` longer runs are
    cut into pieces of at most that many characters.
    """
    w = Window.partitionBy(*key, "dist").orderBy("pos")
    m = matches.withColumn("_rn", F.row_number().over(w)).withColumn("_isl", F.col("pos") - F.col("_rn"))
    if max_len is None:
        m = m.withColumn("_piece", F.lit(0))
    else:
        w2 = Window.partitionBy(*key, "dist", "_isl").orderBy("pos")
        m = m.withColumn("_piece", F.floor((F.row_number().over(w2) - 1) / (max_len - k + 1)))
    return (m.groupBy(*key, "dist", "_isl", "_piece")
            .agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("_grams"))
            .select(*key, "start", "dist", (F.col("_grams") + k - 1).alias("length")))


def run_lengths(seq: DataFrame, key: Sequence[str], order: str = "symbol", value: str = "count",
                zero_run: int = 5, equal_run: int = 7) -> DataFrame:
    """Runs of equal values along ``order``; flags runs worth collapsing
    (at least ``zero_run`` zeros or ``equal_run`` equal non-zero values)."""
    w = Window.partitionBy(*key, value).orderBy(order)
    s = seq.withColumn("_isl", F.col(order) - F.row_number().over(w))
    runs = (s.groupBy(*key, value, "_isl")
            .agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("run_length"))
            .drop("_isl"))
    collapsible = F.when(F.col(value) == 0, F.col("run_length") >= zero_run).otherwise(
        F.col("run_length") >= equal_run)
    return runs.withColumn("collapsible", collapsible)


def range_histogram(symbols: DataFrame, ranges: DataFrame, key: Sequence[str]) -> DataFrame:
    """Histogram of the positions [lo, hi) of each item.

    ``symbols``: (key, pos, symbol); ``ranges``: (key, lo, hi). An equi join
    on the item plus a range filter, then a partial aggregate; this answers
    any set of ranges without materialising running histograms.
    """
    j = symbols.join(ranges, list(key))
    return (j.where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
            .groupBy(*key, "symbol").agg(F.count(F.lit(1)).alias("count")))


def range_histogram_in_row(df: DataFrame, key: Sequence[str], symbols: Column, lo: Column, hi: Column) -> DataFrame:
    """Z10 for a range of each row: its symbols are cut out of the row's array
    before they are exploded, so only the range is counted and nothing joined."""
    size = F.greatest(hi - lo, F.lit(0)).cast("int")
    return symbol_histogram(df, key, F.slice(symbols, (lo + 1).cast("int"), size))


RANGE_TYPE = "struct<range_no: array<int>, symbol: array<int>, count: array<bigint>>"
#: Symbols between two running histograms of a text.
HISTOGRAM_BLOCK = 4096
#: Ranges of one item that are answered beside one copy of its text.
RANGE_BATCH = 1000


def _range_counts(text: str, lows, highs, block: int = HISTOGRAM_BLOCK):
    """(range, code point, count) arrays of the positions [low, high) of each range.

    Running histograms stand at block ends, blocks being no shorter than the
    alphabet, so they take no more numbers than the text. The histogram up to a
    position is that of its block's start plus the partial block, and a range is
    the difference of two of them, however many ranges there are.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    if not n:
        return [np.zeros(0, np.int32)] * 2 + [np.zeros(0, np.int64)]
    codes, alphabet = _renumbered(cp)
    symbols = np.zeros(alphabet, np.int32)
    symbols[codes] = cp
    block = max(block, alphabet)
    cell = np.arange(n) // block * alphabet + codes.astype(np.int64)
    running = np.zeros((n // block + 2, alphabet), np.int64)
    np.cumsum(np.bincount(cell, minlength=(n // block + 1) * alphabet).reshape(-1, alphabet), axis=0, out=running[1:])

    def up_to(at: int):
        return running[at // block] + np.bincount(codes[at // block * block:at].astype(np.int64), minlength=alphabet)

    out = []
    for k, (low, high) in enumerate(zip(lows, highs)):
        low, high = min(max(int(low), 0), n), min(max(int(high), 0), n)
        times = up_to(high) - up_to(low) if low < high else np.zeros(alphabet, np.int64)
        found = np.flatnonzero(times)
        out.append((np.full(len(found), k, np.int32), symbols[found], times[found]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int32)] * 2 + [np.zeros(0, np.int64)]


def range_histograms_in_row(df: DataFrame, key: Sequence[str], text: str, lows: Column, highs: Column) -> DataFrame:
    """Z10 for many ranges of a row, given as two arrays: (key..., range_no,
    symbol, count). The text stays in its row and isn't exploded; positions
    beyond it are cut off, an empty range has no rows."""
    @F.pandas_udf(RANGE_TYPE)
    def count(s: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        out = [_range_counts(t or "", a if a is not None else [], b if b is not None else []) for t, a, b in zip(s, low, high)]
        return pd.DataFrame({name: [o[k] for o in out] for k, name in enumerate(("range_no", "symbol", "count"))})
    rows = df.select(*key, count(F.col(text), lows, highs).alias("_r"))
    flat = explode_struct_arrays(rows, key, "_r", ["range_no", "symbol", "count"])
    return flat.withColumn("symbol", character(F.col("symbol")))


def range_histograms(df: DataFrame, ranges: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Z10 for a table of ranges (key..., range_id, lo, hi): (key..., range_id,
    symbol, count). Ranges meet the text in batches of about ``RANGE_BATCH`` of
    an item, so no row grows with the number of ranges."""
    many = ranges.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / RANGE_BATCH).alias("_batches"))
    dealt = ranges.join(many, list(key)).withColumn("_batch", F.expr("pmod(xxhash64(range_id), _batches)"))
    batches = dealt.groupBy(*key, "_batch").agg(F.collect_list(F.struct("range_id", "lo", "hi")).alias("_ranges"))
    x = df.select(*key, text).join(batches, list(key))
    rows = range_histograms_in_row(x, [*key, "_ranges"], text, F.col("_ranges.lo"), F.col("_ranges.hi"))
    return rows.select(*key, F.get("_ranges", F.col("range_no"))["range_id"].alias("range_id"), "symbol", "count")


def chunk(df: DataFrame, key: Sequence[str], text: str, size: int) -> DataFrame:
    """Fixed-size pieces (last one short; empty input -> one empty piece)."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    return (df.select(*key, text, F.posexplode(starts).alias("chunk_no", "offset"))
            .withColumn("piece", F.expr(f"substring({text}, offset + 1, {int(size)})"))
            .drop(text))


# ------------------------------------------------------------ in-row back-references
# A document is one row, so its k-grams are already co-located: scanning the
# text once per row finds every nearest previous occurrence without shuffling
# one row per character (the window form above shuffles and sorts all of them).
MATCH_TYPE = "struct<pos: array<int>, dist: array<int>>"
SPAN_TYPE = "struct<start: array<int>, dist: array<int>, length: array<int>>"


def _nearest_matches(text: str, k: int, window: int | None):
    """Positions whose k-gram occurred before (nearest previous), distance
    below ``window`` where one is given.

    Code points are packed into one integer key per position, 21 bits per
    character; before a key of three grows, equal keys are renumbered. A
    stable argsort puts equal keys next to each other in position order, so
    neighbours are nearest previous occurrences.
    """
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(cp) - k + 1
    if n <= 1:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    # few distinct characters and a short gram: gram and position fit one number, sorted at once
    codes, alphabet = _renumbered(cp)
    bits, at_bits = max(1, int(alphabet - 1).bit_length()), int(n).bit_length()
    if bits * k + at_bits <= 64:
        packed = np.zeros(n, np.uint64)
        for j in range(k):
            packed = (packed << np.uint64(bits)) | codes[j:j + n]
        packed = np.sort((packed << np.uint64(at_bits)) | np.arange(n, dtype=np.uint64))
        gram, at = packed >> np.uint64(at_bits), (packed & np.uint64((1 << at_bits) - 1)).astype(np.int64)
        same = gram[1:] == gram[:-1]
        return _in_position_order(at[1:][same], at[:-1][same], n, window)
    key = cp[:n].copy()
    for j in range(1, k):
        if j >= 3:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = (key << np.uint64(21)) | cp[j:j + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    return _in_position_order(order[1:][same], order[:-1][same], n, window)


def _renumbered(cp):
    """Code points as 0, 1, 2... and how many there are."""
    if int(cp.max()) < 1 << 16:
        seen = np.zeros(int(cp.max()) + 1, bool)
        seen[cp] = True
        return (np.cumsum(seen) - 1).astype(np.uint64)[cp], int(seen.sum())
    found, codes = np.unique(cp, return_inverse=True)
    return codes.astype(np.uint64), len(found)


def _in_position_order(cur, prev, n: int, window: int | None):
    """(position, distance to the occurrence before) by rising position."""
    dist = np.zeros(n, np.int32)
    dist[cur] = cur - prev
    if window is not None:
        dist[dist >= window] = 0
    pos = np.flatnonzero(dist)
    return pos.astype(np.int32), dist[pos]


def _spans_from_matches(pos, dist, k: int, max_len: int | None):
    """Runs of consecutive positions with one distance, cut into pieces of at
    most ``max_len`` characters if that is given: (start, dist, length) arrays."""
    per_piece = max(1, len(pos)) if max_len is None else max_len - k + 1
    if len(pos) == 0:
        z = np.zeros(0, np.int32)
        return z, z, z
    cont = (np.diff(pos) == 1) & (dist[1:] == dist[:-1])
    starts = np.flatnonzero(np.r_[True, ~cont])
    runs = np.diff(np.r_[starts, len(pos)])
    npieces = (runs + per_piece - 1) // per_piece
    run_id = np.repeat(np.arange(len(runs)), npieces)
    piece_no = np.arange(int(npieces.sum())) - np.repeat(np.cumsum(npieces) - npieces, npieces)
    grams = np.minimum(per_piece, runs[run_id] - piece_no * per_piece)
    start = pos[starts][run_id] + piece_no * per_piece
    return start.astype(np.int32), dist[starts][run_id].astype(np.int32), (grams + k - 1).astype(np.int32)


def previous_occurrence_in_row(text: Column, k: int = MIN_MATCH, window: int | None = None) -> Column:
    """Z7 per document row: struct(pos[], dist[]) of positions whose k-gram
    occurred before (nearest previous occurrence), within ``window`` if given."""
    @F.pandas_udf(MATCH_TYPE)
    def matches(s: pd.Series) -> pd.DataFrame:
        out = [_nearest_matches(t or "", k, window) for t in s]
        return pd.DataFrame({"pos": [o[0] for o in out], "dist": [o[1] for o in out]})
    return matches(text)


def repeated_spans_in_row(text: Column, k: int = MIN_MATCH, window: int | None = None,
                          max_len: int | None = None) -> Column:
    """Z8 per document row: struct(start[], dist[], length[]) of back-reference spans."""
    @F.pandas_udf(SPAN_TYPE)
    def spans(s: pd.Series) -> pd.DataFrame:
        out = [_spans_from_matches(*_nearest_matches(t or "", k, window), k, max_len) for t in s]
        return pd.DataFrame({"start": [o[0] for o in out], "dist": [o[1] for o in out],
                             "length": [o[2] for o in out]})
    return spans(text)


MATCH_SUMMARY = "struct<n: bigint, sum: bigint, max: bigint>"


def match_summary_in_row(text: Column, k: int = MIN_MATCH, window: int | None = None) -> Column:
    """Z7 summed inside the row: struct(n, sum, max) of the distances; sum and
    max are NULL without a match. Matches themselves stay in the task."""
    @F.arrow_udf(MATCH_SUMMARY)
    def summary(s: pa.Array) -> pa.Array:
        return _in_turn(s, lambda t: _summary(_nearest_matches(t, k, window)[1]), MATCH_ARROW)
    return summary.asNondeterministic()(text)


def span_summary_in_row(text: Column, k: int = MIN_MATCH, window: int | None = None, max_len: int | None = None) -> Column:
    """Z8 summed inside the row: struct(n, sum, max) of the span lengths."""
    @F.arrow_udf(MATCH_SUMMARY)
    def summary(s: pa.Array) -> pa.Array:
        return _in_turn(s, lambda t: _summary(_spans_from_matches(*_nearest_matches(t, k, window), k, max_len)[2]), MATCH_ARROW)
    return summary.asNondeterministic()(text)


def distance_histogram_in_row(text: Column, k: int = MIN_MATCH, window: int | None = None) -> Column:
    """Z16 over Z7 inside the row: struct(symbol[], count[]) of the distance
    buckets, named by the smallest distance of each: buckets are given by
    ``distance_bucket`` of it."""
    def buckets(t: str):
        less = _nearest_matches(t, k, window)[1].astype(np.int64) - 1
        # below 4 every distance is its own; then the top two bits count
        low = np.maximum(np.frexp(np.maximum(less, 1).astype(float))[1] - 2, 0)
        return _counts(((less >> low) << low) + 1)

    @F.arrow_udf(HISTOGRAM_TYPE)
    def histogram(s: pa.Array) -> pa.Array:
        return _in_turn(s, buckets, HISTOGRAM_ARROW)
    return histogram.asNondeterministic()(text)


MATCH_ARROW = {"n": pa.int64(), "sum": pa.int64(), "max": pa.int64()}
HISTOGRAM_ARROW = {"symbol": pa.list_(pa.int32()), "count": pa.list_(pa.int64())}


def _in_turn(texts: pa.Array, answer, fields: dict) -> pa.Array:
    """Structs of ``answer(text)`` for each text of a batch.

    One text at a time is taken out of the batch, and only its answer is kept:
    a worker holds the batch once and the arrays of one text. (The functions
    that use it are called non-deterministic, since the planner runs others a
    second time, in workers of their own, for a filter on their result.)
    """
    rows = [answer(t.as_py() or "") for t in texts]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(fields.values())], list(fields))


def _summary(v):
    """(how many, sum, greatest) of an array; the last two None if it is empty."""
    return (len(v), int(v.sum(dtype=np.int64)), int(v.max())) if len(v) else (0, None, None)


def explode_struct_arrays(df: DataFrame, key: Sequence[str], col: str, fields: Sequence[str]) -> DataFrame:
    """Rows out of a struct of parallel arrays (narrow: no shuffle)."""
    z = F.arrays_zip(*[F.col(f"{col}.{f}").alias(f) for f in fields])
    return df.select(*key, F.explode(z).alias("_z")).select(*key, *[F.col(f"_z.{f}").alias(f) for f in fields])
