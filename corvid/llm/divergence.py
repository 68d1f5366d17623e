"""How the sources of each language differ in their terms.

Counts of a term within a group (language, source) are its *levels*. A block of
terms becomes a matrix of indicator columns, one for each (group, level) that
occurs in it; the product of its transpose with itself holds, for every two
groups, how many terms have which pair of levels: their joint table. Blocks add
up, so the joint tables of all groups come from one pass over the blocks, and a
divergence that adds up over terms is priced a cell at a time instead of a term
at a time.

A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased. A
language keeps the terms found in at least ``min_docs`` of its documents. With N
the occurrences of kept terms in a group and V the kept terms, a count c has the
probability ``1 + floor(10^9 (c + 2) / (N + 2 V))`` in billionths, and two
probabilities p and q differ by ``floor((p - q)^2 / (p + q))``. All numbers are
integers: products hold counts below 2^24 and are exact in 32-bit floats.

Defined results: a null language, source or text is the empty string; every
group that occurs is reported, one without terms has count 0 everywhere; in a
language without kept terms all pairs have value 0; repeated rows count as often
as they occur; ties are ordered by the UTF-8 bytes of the item; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import keep, small_join, stored

#: Terms of a block (the rows of its matrix).
BLOCK_TERMS = 512
#: Columns of one tile of a block's product, unless one group has more.
TILE_COLUMNS = 2048
#: Distinct (group, term) counts that a task holds before it sends them on.
HELD_TERMS = 300_000

_TERM = np.full(256, 32, dtype=np.uint8)
_TERM[128:] = np.arange(128, 256)
_TERM[97:123] = np.arange(97, 123)
_TERM[65:91] = np.arange(97, 123)

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by (lang, source, term) of a task, in runs of ``HELD_TERMS``."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                part = terms[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                     pa.array(part, pa.string()), pa.array([n[t] for t in part], pa.int64()),
                     pa.array([docs[t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = _TERM[np.frombuffer(text.as_buffer(), np.uint8)].tobytes().split()
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size > HELD_TERMS:
                yield from flush()
                size = 0
    yield from flush()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term.
    Tasks count before anything is shuffled."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")) for c in (lang, source, text)])
    parts = rows.mapInArrow(_counted, _COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, source, term, n, lang_n) of the terms in at least ``min_docs``
    documents of their language; lang_n counts the whole language. A window
    holds one row a source."""
    over = Window.partitionBy("lang", "term")
    rows = counts.withColumns({"lang_n": F.sum("n").over(over), "lang_docs": F.sum("docs").over(over)})
    return rows.filter(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n")


def billionths(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed probability; the product is formed in 38 digits."""
    top = F.lit(10**9).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)"))
    low = total.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)") * terms.cast("decimal(20,0)")
    return F.call_function("div", top, low) + F.lit(1).cast("bigint")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Levels:
    """Kept counts, groups and blocks of terms: what products are made of."""

    def __init__(self, docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                 min_docs: int = 10, block_terms: int = BLOCK_TERMS):
        self.kept = stored(kept_terms(term_counts(docs, lang, source, text), min_docs), "divergence-kept")
        # terms of a language by the size of their count: rare terms have few levels, so their blocks have few columns
        self.terms = self.kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).withColumn(
            "size", F.length(F.bin("lang_n")))
        sizes = keep(self.terms.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("n")))
        langs = sizes.groupBy("lang").agg(F.sum("terms").alias("terms"), F.sum("n").alias("lang_total"))
        seen = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        self.groups = keep(seen.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"]))
        self.n_groups = self.groups.count()
        self.blocks = keep(sizes.select("lang", "size", F.ceil(F.col("terms") / block_terms).cast("int").alias("parts")))

    def priced(self) -> DataFrame:
        """(lang, source, term, n, lang_n, p, q): probabilities in the group and in the language."""
        rows = small_join(self.kept, self.groups, ["lang", "source"], self.n_groups)
        return rows.select("lang", "source", "term", "n", "lang_n", billionths(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
                           billionths(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))

    def by_block(self) -> DataFrame:
        """(lang, size, part, term, source, n, p): the counts of each block of
        terms, and for each group a row without a term that prices count 0.
        A language also has one block without terms, so all its pairs occur."""
        n_blocks = self.blocks.count()
        rows = small_join(self.priced().withColumn("size", F.length(F.bin("lang_n"))), self.blocks, ["lang", "size"], n_blocks)
        rows = rows.select("lang", "size", F.expr("pmod(xxhash64(term), parts)").cast("int").alias("part"), "term", "source", "n", "p")
        zero = F.when(F.col("terms") > 0, billionths(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1)
        zeros = self.groups.select("lang", "source", zero.cast("bigint").alias("p"))
        parts = self.blocks.select("lang", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        parts = parts.union(self.groups.select("lang", F.lit(0), F.lit(0)).distinct())
        marks = zeros.join(parts, "lang").select("lang", "size", "part", F.lit(None).cast("string"), "source",
                                                 F.lit(0).cast("bigint"), "p")
        return rows.union(marks)


def one_hot_product(counts: np.ndarray, tile: int = TILE_COLUMNS) -> Iterator[tuple[np.ndarray, ...]]:
    """Joint tables of the rows of ``counts`` (groups x terms).

    Yields (group, level, other group, other level, terms) arrays: the cells
    above 0 of one tile of the product of the indicator matrix with itself,
    the first group before the second.
    """
    groups, n = counts.shape
    tiles, at = [], 0
    while at < groups:
        columns, owners, levels = [], [], []
        width, first = 0, at
        while at < groups and (at == first or width < tile):
            values, place = np.unique(counts[at], return_inverse=True)
            columns.append(width + place)
            owners.append(np.full(len(values), at))
            levels.append(values)
            width, at = width + len(values), at + 1
        hot = np.zeros((n, width), np.float32)
        for column in columns:
            hot[np.arange(n), column] = 1
        tiles.append((hot, np.concatenate(owners), np.concatenate(levels)))
    for i, (hot, owner, level) in enumerate(tiles):
        for other_hot, other_owner, other_level in tiles[i:]:
            product = hot.T @ other_hot
            a, b = np.nonzero(product)
            first = owner[a] < other_owner[b]
            a, b = a[first], b[first]
            yield owner[a], level[a], other_owner[b], other_level[b], product[a, b].astype(np.int64)


def _block(table: pa.Table) -> tuple[str, list[str], np.ndarray, np.ndarray]:
    """(lang, sources, counts, prices) of a block; both arrays are groups x
    terms, and price 0 is in the last column."""
    frame = table.select(["term", "source", "n", "p"]).to_pandas()
    marks = frame["term"].isna().to_numpy()
    sources = sorted(frame["source"][marks].unique())
    of = {s: i for i, s in enumerate(sources)}
    group = frame["source"].map(of).to_numpy()
    term, names = frame["term"].factorize()
    counts = np.zeros((len(sources), len(names)), np.int64)
    counts[group[~marks], term[~marks]] = frame["n"].to_numpy()[~marks]
    prices = np.zeros((len(sources), len(names) + 1), np.int64)
    prices[:] = 0
    prices[group[marks], -1] = frame["p"].to_numpy()[marks]
    prices[:, :-1] = prices[:, -1:]
    prices[group[~marks], term[~marks]] = frame["p"].to_numpy()[~marks]
    return table.column("lang")[0].as_py(), sources, counts, prices


def _priced_block(table: pa.Table) -> pa.Table:
    lang, sources, counts, prices = _block(table)
    known = [dict(zip(c.tolist(), p.tolist())) | {0: int(p[-1])} for c, p in zip(counts, prices)]
    levels = [np.array(sorted(k), np.int64) for k in known]
    price = [np.array([k[x] for x in v.tolist()], np.int64) for k, v in zip(known, levels)]
    starts = np.cumsum([0] + [len(v) for v in levels])
    flat = np.concatenate(price) if price else np.zeros(0, np.int64)

    def priced(group: np.ndarray, level: np.ndarray) -> np.ndarray:
        out = np.zeros(len(group), np.int64)
        for g in np.unique(group):
            at = group == g
            out[at] = flat[starts[g] + np.searchsorted(levels[g], level[at])]
        return out

    total = np.zeros((len(sources), len(sources)), np.int64)
    for a, x, b, y, terms in one_hot_product(counts):
        p, q = priced(a, x), priced(b, y)
        np.add.at(total, (a, b), terms * ((p - q) * (p - q) // (p + q)))
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    total += total.T
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array([sources[i] for i in a], pa.string()),
                     pa.array([sources[i] for i in b], pa.string()), pa.array(total[a, b], pa.int64())],
                    names=["lang", "source", "item", "value"])


def _cells(table: pa.Table) -> pa.Table:
    lang, sources, counts, _ = _block(table)
    parts = [pa.table([pa.array([lang] * len(a), pa.string()), pa.array([sources[i] for i in a], pa.string()), pa.array(x),
                       pa.array([sources[i] for i in b], pa.string()), pa.array(y), pa.array(terms)],
                      names=["lang", "source", "level", "other", "other_level", "terms"])
             for a, x, b, y, terms in one_hot_product(counts)]
    names = ["lang", "source", "level", "other", "other_level", "terms"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.concat_tables(parts) if parts else pa.table([pa.array([], k) for k in kinds], names=names)


def joint_tables(levels: Levels) -> DataFrame:
    """(lang, source, level, other, other_level, terms): for each two sources
    of a language, the first before the second, how many kept terms occur
    ``level`` times in the one and ``other_level`` times in the other."""
    cells = levels.by_block().groupBy("lang", "size", "part").applyInArrow(
        _cells, "lang string, source string, level bigint, other string, other_level bigint, terms bigint")
    return cells.groupBy("lang", "source", "level", "other", "other_level").agg(F.sum("terms").alias("terms"))


def pair_values(levels: Levels) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each
    other source of its language; cells are priced where they are made."""
    priced = levels.by_block().groupBy("lang", "size", "part").applyInArrow(
        _priced_block, "lang string, source string, item string, value bigint")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(levels: Levels) -> DataFrame:
    """(lang, source, item, value): the terms that a source has more often
    than its language, and what each adds to the divergence from it."""
    return levels.priced().filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))


def audit_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                     min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks all other
    sources of the language, part ``term`` the ``top_terms`` leading terms."""
    levels = Levels(docs, lang, source, text, min_docs)
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = pair_values(levels).withColumn("rank", F.row_number().over(by))
    terms = term_values(levels).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")
