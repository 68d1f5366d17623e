"""LM scoring by prediction by partial matching.

The model is a trie of byte contexts, longest first: a symbol seen in the
context is coded there, else an escape is coded and the next shorter context
is tried without the symbols that the longer one could have given (symbol
exclusion); an escape is as likely as the context has different symbols
(method C). Below the empty context all symbols left are equal. The counts are
pretrained on all training documents; a document's score is the log10
probability of its bytes and of its end.

Tasks count n-grams of their documents, Spark adds them up; every n-gram
counts. Up to ``max_grams`` of them the whole trie is sent to the tasks. Beyond
that the trie stays in tables, and the tasks hold the scores of the most
frequent n-grams alone; what else occurs in a text is scored once a distinct
n-gram by joins with the tables, so what is sent has a fixed bound and the
scores are the same.

A word unigram model with add-0.1 smoothing stands beside it. Its most
frequent words go with the model under the same kind of bound; words beyond
it are looked up by a join, so every count is exact.

Defined results: a null text is empty and only has its end; a null id counts
as the empty text (held out); repeated rows are trained on and scored one by
one; an empty table gives an empty result, and without training documents
every symbol has the same probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import keep, stored
from corvid.llm.hashing import LOWER, pieces, word_hashes

BITS = 9
END, PAD, SYMBOLS = 256, 257, 257
MAX_GRAMS = 1 << 21
MAX_WORDS = 1 << 21
#: Counts held by a task before it passes them on.
TASK_COUNTS = 4_000_000
#: Stands for the end of a text among the word hashes.
END_WORD = np.uint64(0x5EED0E0D)


def gram_codes(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of each position's context and symbol, first position of each row)."""
    lengths = np.diff(offsets)
    rows = np.arange(len(lengths))
    seq = np.full(len(data) + (order + 1) * len(lengths), PAD, np.int64)
    first = offsets[:-1] + (order + 1) * rows + order
    seq[np.arange(len(data)) + np.repeat((order + 1) * rows + order, lengths)] = data
    seq[first + lengths] = END
    codes = seq.copy()
    for back in range(1, order + 1):
        codes[back:] |= seq[:-back] << (BITS * back)
    mask = np.zeros(len(seq), bool)
    mask[np.arange(len(data) + len(lengths)) + np.repeat((order) * (rows + 1), lengths + 1)] = True
    return codes[mask], offsets[:-1] + rows


class Counter:
    """Sums of counts by 64-bit key, merged as they grow."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        part = np.unique(keys, return_counts=True)
        self.parts.append(part)
        self.size += len(part[0])

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in self.parts]), len(keys)).astype(np.int64)
            self.parts, self.size = [(keys, counts)], len(keys)


def corpus_counts(docs: DataFrame, text: str, order: int) -> DataFrame:
    """(kind, key, n): n-grams (kind 0) and word hashes (kind 1) of all rows."""
    def run(batches):
        np.seterr(over="ignore")
        grams, words, merged = Counter(), Counter(), [0, 0]

        def out(kind, counter):
            counter.merge()
            for keys, counts in counter.parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["kind", "key", "n"])
            counter.parts, counter.size = [], 0

        for batch in batches:
            for _, data, offsets in pieces(batch.column(0), lower=False):
                grams.add(gram_codes(data, offsets, order)[0])
                words.add(word_hashes(LOWER[data], offsets)[0])
                words.add(np.full(len(offsets) - 1, END_WORD))
                for kind, counter in enumerate((grams, words)):
                    if counter.size > max(TASK_COUNTS, 2 * merged[kind]):
                        counter.merge()
                        merged[kind] = counter.size
                        if counter.size > TASK_COUNTS:
                            yield from out(kind, counter)
                            merged[kind] = 0
        yield from out(0, grams)
        yield from out(1, words)

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind int, key bigint, n bigint")
    return keep(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")))


def most_frequent(counts: DataFrame, most: int, value: str = "n") -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, values) of the rows with the highest counts, ``most`` at
    most: a floor is taken from the histogram of the counts' logarithms."""
    step = F.floor(F.log2("n") * 8).cast("int")
    floor = -1
    total = 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            floor = r["step"]
            break
    got = counts.filter(step > floor).select("key", value).toArrow()
    keys, values = got["key"].to_numpy(), got[value].to_numpy()
    at = np.argsort(keys)
    return keys[at], values[at]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of keys in a sorted table."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys if len(table) else np.zeros(len(keys), bool))


@dataclass
class Trie:
    """Per order k: sorted n-grams of k + 1 symbols with counts, their contexts
    with total and number of symbols, and what is left of the next shorter
    context when this one's symbols are excluded."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]

    def __post_init__(self):
        self.contexts, self.total, self.kinds, self.left, self.left_kinds = [], [], [], [], []
        for k, (grams, counts) in enumerate(zip(self.grams, self.counts)):
            contexts, at = np.unique(grams >> BITS, return_inverse=True)
            total = np.bincount(at, counts, len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            left = left_kinds = np.zeros(len(contexts))
            if k:
                low = (1 << (BITS * k)) - 1
                place, seen = _find(self.grams[k - 1], grams & low)
                given = np.bincount(at, np.where(seen, self.counts[k - 1][place] if len(self.counts[k - 1]) else 0, 0), len(contexts))
                given_kinds = np.bincount(at, seen, len(contexts))
                below, known = _find(self.contexts[k - 1], contexts & (low >> BITS))
                left = np.where(known, self.total[k - 1][below] - given, 0) if len(below) else left
                left_kinds = np.where(known, self.kinds[k - 1][below] - given_kinds, 0) if len(below) else left
            for held, value in ((self.contexts, contexts), (self.total, total), (self.kinds, kinds), (self.left, left),
                                (self.left_kinds, left_kinds)):
                held.append(value)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's symbol in its context."""
        score = np.zeros(len(codes))
        active = np.arange(len(codes))
        above = np.full(len(codes), -1)
        for k in range(len(self.grams) - 1, -1, -1):
            if not len(self.grams[k]) or not len(active):
                above[active] = -1
                continue
            own = codes[active] & ((1 << (BITS * (k + 1))) - 1)
            context, known = _find(self.contexts[k], own >> BITS)
            gram, seen = _find(self.grams[k], own)
            start = above[active] < 0
            longer = above[active]
            room = np.where(start, self.total[k][context] + self.kinds[k][context],
                            self.left[k + 1][longer] + self.left_kinds[k + 1][longer] if k + 1 < len(self.left) and len(self.left[k + 1]) else 0)
            escapes = np.where(start, self.kinds[k][context],
                               self.left_kinds[k + 1][longer] if k + 1 < len(self.left) and len(self.left[k + 1]) else 0)
            use = known & (room > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = np.log10(self.counts[k][gram] / room)
                miss = np.log10(escapes / room)
            done = use & seen
            score[active] += np.where(done, hit, np.where(use & (escapes > 0), miss, 0.0))
            above[active] = np.where(known, context, -1)
            active = active[~done]
        # all symbols that the empty context lacks are alike
        rest = SYMBOLS - (self.kinds[0][0] if len(self.grams[0]) else 0)
        score[active] -= np.log10(max(rest, 1))
        return score


def fit_trie(grams: DataFrame, order: int, max_grams: int = MAX_GRAMS) -> Trie:
    """From (key, n) of the longest n-grams; shorter ones are their sums. It is
    the whole trie where the longest are ``max_grams`` at most, as each shorter
    one ends a longer one."""
    tables = {}
    for k in range(order, -1, -1):
        at = F.col("key").bitwiseAND(F.lit((1 << (BITS * (k + 1))) - 1))
        level = grams if k == order else grams.groupBy(at.alias("key")).agg(F.sum("n").alias("n"))
        tables[k] = most_frequent(level, max_grams)
    return Trie([tables[k][0] for k in range(order + 1)], [tables[k][1] for k in range(order + 1)])


def _low(key: str, symbols: int) -> Column:
    """The last symbols of a code."""
    return F.col(key).bitwiseAND(F.lit((1 << (BITS * symbols)) - 1))


def gram_levels(grams: DataFrame, order: int) -> list[DataFrame]:
    """(key, n) of all n-grams of k + 1 symbols, for each order k."""
    levels = [grams]
    for k in range(order - 1, -1, -1):
        levels.insert(0, stored(levels[0].groupBy(_low("key", k + 1).alias("key")).agg(F.sum("n").alias("n")), "ppm-grams"))
    return levels


def context_tables(levels: list[DataFrame]) -> list[DataFrame]:
    """(context, total, kinds, left, left_kinds) of all contexts of each order:
    as in ``Trie``. A key meets as many rows as there are symbols at most."""
    tables = []
    for k, grams in enumerate(levels):
        x = grams.withColumn("context", F.shiftright("key", BITS))
        sums = [F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")]
        if k:
            given = levels[k - 1].select(F.col("key").alias("low"), F.col("n").alias("given"))
            shorter = tables[k - 1].select(F.col("context").alias("low"), F.col("total").alias("all"), F.col("kinds").alias("all_kinds"))
            x = x.withColumn("low", _low("key", k)).join(given, "low").groupBy("context").agg(*sums, F.sum("given").alias("given"))
            x = x.withColumn("low", _low("context", k - 1)).join(shorter, "low").select(
                "context", "total", "kinds", (F.col("all") - F.col("given")).alias("left"), (F.col("all_kinds") - F.col("kinds")).alias("left_kinds"))
        else:
            x = x.groupBy("context").agg(*sums).withColumns({"left": F.lit(0).cast("bigint"), "left_kinds": F.lit(0).cast("bigint")})
        tables.append(stored(x, "ppm-contexts"))
    return tables


def code_scores(codes: DataFrame, levels: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """(key, s): log10 probability of the symbol in its context, for distinct
    codes, as ``Trie.log10`` gives it for a whole trie.

    From the empty context up, s is the score from this context on and y the
    score that follows an escape from it. A code is joined to its own count, to
    its context and to the code without its first symbol.
    """
    asked = [codes]
    for k in range(len(levels) - 2, -1, -1):
        asked.insert(0, stored(asked[0].select(_low("key", k + 1).alias("key")).distinct(), "ppm-asked"))
    rest = SYMBOLS - contexts[0].first()["kinds"]
    below = None
    for k, x in enumerate(asked):
        x = x.join(levels[k], "key", "left").withColumn("context", F.shiftright("key", BITS)).join(contexts[k], "context", "left")
        if k:
            x = x.withColumn("low", _low("key", k)).join(
                below.select(F.col("key").alias("low"), F.col("n").alias("low_n"), F.col("s").alias("low_s"), F.col("y").alias("low_y")), "low")
            room = F.log10(F.col("left") + F.col("left_kinds"))
            escape = F.when(F.col("left_kinds") > 0, F.log10("left_kinds") - room).otherwise(F.lit(0.0))
            y = F.when(F.col("low_n").isNotNull(), F.log10("low_n") - room).otherwise(escape + F.col("low_y"))
        else:
            # all symbols that the empty context lacks are alike
            x = x.withColumn("low_s", F.lit(0.0))
            y = F.lit(-float(np.log10(max(rest, 1))))
        room = F.log10(F.col("total") + F.col("kinds"))
        s = (F.when(F.col("total").isNull(), F.col("low_s")).when(F.col("n").isNotNull(), F.log10("n") - room)
             .otherwise(F.log10("kinds") - room + F.col("y")))
        below = stored(x.withColumn("y", y).select("key", "n", s.alias("s"), "y"), "ppm-scores")
    return below.select("key", "s")


def held_out(key: Column, parts: int = 10) -> Column:
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % parts == 0


def score_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = 5, max_grams: int = MAX_GRAMS,
                max_words: int = MAX_WORDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every document; both models learn from those that are not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), held_out(F.col(key)).alias("held_out"))
    counts = corpus_counts(rows.filter(~F.col("held_out")), "text", order)
    grams = counts.filter("kind = 0").select("key", "n")
    whole = grams.count() <= max_grams
    trie, levels, contexts = None, [], []
    top_codes = top_scores = np.zeros(0)
    if whole:
        trie = fit_trie(grams, order, max_grams)
    else:
        levels = gram_levels(grams, order)
        contexts = context_tables(levels)
        hit = (F.log10("n") - F.log10(F.col("total") + F.col("kinds"))).alias("s")
        in_context = grams.withColumn("context", F.shiftright("key", BITS)).join(contexts[order], "context").select("key", "n", hit)
        top_codes, top_scores = most_frequent(stored(in_context, "ppm-hits"), max_grams, "s")
    words = counts.filter("kind = 1").select("key", "n")
    row = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, vocabulary = int(row[0]), int(row[1])
    top_keys, top_counts = most_frequent(words.filter(F.col("key") != int(END_WORD)), max_words)
    ends = words.filter(F.col("key") == int(END_WORD)).first()
    ends = int(ends["n"]) if ends else 0
    sent = spark.sparkContext.broadcast((trie, top_codes, top_scores, top_keys, top_counts))
    all_sent = vocabulary <= len(top_keys) + 1

    def run(batches):
        np.seterr(over="ignore")
        trie, scored_codes, code_values, keys, known_counts = sent.value
        for batch in batches:
            n = len(batch)
            score, logs, n_tokens, n_known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            rare: list[np.ndarray] = [np.zeros(0, np.int64)] * n
            far, times = list(rare), list(rare)
            for at, data, offsets in pieces(batch.column(1), lower=False):
                to = at + len(offsets) - 1
                codes, first = gram_codes(data, offsets, order)
                distinct, back = np.unique(codes, return_inverse=True)
                if whole:
                    value = trie.log10(distinct)
                else:
                    place, found = _find(scored_codes, distinct)
                    value = np.where(found, code_values[place] if len(code_values) else 0, 0.0)
                    missing, ends_at = ~found[back], np.append(first[1:], len(codes))
                    for i, (a, b) in enumerate(zip(first, ends_at)):
                        far[at + i], times[at + i] = np.unique(codes[a:b][missing[a:b]], return_counts=True)
                score[at:to] = np.add.reduceat(value[back], first)
                hashes, bounds = word_hashes(LOWER[data], offsets)
                distinct, back = np.unique(hashes.view(np.int64), return_inverse=True)
                place, found = _find(keys, distinct)
                c = np.where(found, known_counts[place] if len(known_counts) else 0, 0)
                if all_sent:
                    found = np.ones(len(found), bool)
                value = np.where(found, np.log10(c + 0.1), 0.0)[back]
                total = np.concatenate([[0.0], np.cumsum(value)])
                seen = np.concatenate([[0], np.cumsum((c > 0)[back])])
                logs[at:to] = total[bounds[1:]] - total[bounds[:-1]]
                n_known[at:to] = seen[bounds[1:]] - seen[bounds[:-1]] + (ends > 0)
                n_tokens[at:to] = np.diff(bounds) + 1
                if not all_sent:
                    missing = ~found[back]
                    for i in range(to - at):
                        a, b = bounds[i], bounds[i + 1]
                        rare[at + i] = hashes[a:b][missing[a:b]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n_tokens), pa.array(n_known), pa.array(logs), pa.array(score),
                 pa.array(rare, pa.list_(pa.int64())), pa.array(far, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                names=["id", "held_out", "n_tokens", "n_known", "logs", "score", "rare", "far", "times"])

    scored = keep(rows.mapInArrow(run, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, "
                                       "rare array<bigint>, far array<bigint>, times array<bigint>")).withColumn("_row", F.monotonically_increasing_id())
    # words beyond the bound: their counts by a join, added up by row
    looked_up = (scored.select("_row", F.explode("rare").alias("key")).join(words, "key", "left").groupBy("_row")
                 .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("_logs"), F.count("n").alias("_known")))
    out = scored.drop("rare", "far", "times")
    out = out.join(looked_up, "_row", "left") if not all_sent else out.withColumns({"_logs": F.lit(0.0), "_known": F.lit(0)})
    if not whole:
        # n-grams whose scores were not sent: once each from the tables
        asked = scored.select("_row", F.inline(F.arrays_zip("far", "times"))).withColumnRenamed("far", "key")
        scores = code_scores(stored(asked.select("key").distinct(), "ppm-asked"), levels, contexts)
        added = asked.join(scores, "key").groupBy("_row").agg(F.sum(F.col("times") * F.col("s")).alias("_far"))
        out = out.join(added, "_row", "left").withColumn("score", F.col("score") + F.coalesce("_far", F.lit(0.0)))
    scale = float(np.log10(tokens + 0.1 * (vocabulary + 1)))
    end = float(np.log10(ends + 0.1))
    base = F.col("logs") + F.coalesce("_logs", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(scale)
    return out.select("id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
                      F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
