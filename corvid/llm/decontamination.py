"""Benchmark decontamination with a positional inverted index.

The index stores, for the terms that searches start from, every posting of the
corpus (document, position), and a document table. A window of an item's words
is looked up by its rarest terms: the postings of the rarest, moved back by
the term's place in the window, are alignments (window, document, offset); they
are intersected with the moved postings of the next rarest. What is left is
compared with the words of the document, which gives the exact phrases. Equal
windows are one window, however often and in whatever items they stand.

Terms, counts and postings come from whole texts of all documents. No list is
cut: an alignment is a row, so a frequent term only makes more rows. At one
place of a document one window of a length can occur, so what a document holds
of occurrences grows with its words alone, also where all words are equal.

Defined results: a null text has no words; an item without words has no
windows; one with fewer than ``window`` words is one window; documents are
told apart by id and text, so repeated rows and null ids are judged alike; an
empty corpus or benchmark gives documents without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import ascii_lower, keep, small_join, unwrapped, wrapped

#: Splits on every ASCII character that is not a digit or a letter.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Heads each document's postings; no word has this character.
HEADER = "\x00"
#: Alignments are intersected over this many lists of a window.
LISTS = 3


def content_words(text: Column) -> Column:
    """Lower-cased words of digits, letters and non-ASCII characters."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def item_windows(benchmark: DataFrame, window: int, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(_win, _check, _words) of the different windows, and (_item, _win) of
    the items that hold them. A window is known by two 64-bit hashes."""
    items = benchmark.select(F.col(item).alias("_item"), content_words(F.col(text)).alias("_all")).filter(F.size("_all") > 0)
    n = F.size("_all")
    at = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))
    held = items.select("_item", F.explode(F.transform(at, lambda k: F.slice("_all", k + 1, window))).alias("_words"))
    held = keep(held.select("_item", *window_hashes(F.col("_words")), "_words"))
    return keep(held.select("_win", "_check", "_words").dropDuplicates(["_win", "_check"])), held.select("_item", "_win", "_check").distinct()


def window_hashes(words: Column) -> tuple[Column, Column]:
    return F.xxhash64(words).alias("_win"), F.xxhash64(F.lit("check"), words).alias("_check")


def tokens(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(_id, _th, _pos, _term, _n): position 0 is the header, words count from 1."""
    x = docs.select(F.col(key).alias("_id"), F.xxhash64(F.col(text)).alias("_th"), content_words(F.col(text)).alias("_w"))
    return x.select("_id", "_th", F.size("_w").cast("bigint").alias("_n"),
                    F.posexplode(F.concat(F.array(F.lit(HEADER)), "_w")).alias("_pos", "_term"))


class PositionalIndex:
    """Postings of the search terms of a benchmark, and the document table."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", key: str = "doc_id",
                 item: str = "item_id", item_text: str = "text"):
        self.docs, self.text, self.key, self.window = docs, text, key, window
        self.windows, self.items = item_windows(benchmark, window, item, item_text)
        self.n_items = self.items.count()
        places = self.windows.select("_win", "_check", F.size("_words").alias("_len"), F.posexplode("_words").alias("_off", "_term"))
        vocabulary = keep(places.select("_term").distinct())
        words = tokens(docs, text, key)
        known = small_join(words.select("_term"), vocabulary, "_term", vocabulary.count())
        counts = keep(known.groupBy("_term").agg(F.count(F.lit(1)).alias("_count")))
        self.anchors = keep(self._rarest(places.join(counts, "_term")))
        terms = keep(self.anchors.select("_term").distinct()
                     .unionByName(docs.sparkSession.range(1).select(F.lit(HEADER).alias("_term"))))
        self.index = keep(small_join(words, terms, "_term", terms.count())
                          .select("_term", "_id", "_th", (F.col("_pos") - 1).alias("_pos"),
                                  F.when(F.col("_pos") == 0, F.col("_n")).alias("_n")))
        self.n_anchors = self.anchors.count()

    def _rarest(self, places: DataFrame) -> DataFrame:
        """(_win, _check, _len, _last, _rank, _off, _term): the terms that each
        window is looked up by, rarest first, and the last rank. A window with
        a term that the corpus lacks cannot occur and has none."""
        each = places.groupBy("_win", "_check", "_len").agg(F.sort_array(F.collect_list(F.struct("_count", "_off", "_term"))).alias("_all"))
        best = each.filter(F.size("_all") == F.col("_len")).withColumn("_best", F.slice("_all", 1, LISTS))
        return best.select("_win", "_check", "_len", (F.size("_best") - 1).alias("_last"), F.posexplode("_best").alias("_rank", "_b")).select(
            "_win", "_check", "_len", "_last", "_rank", "_b._off", "_b._term")

    def postings(self) -> DataFrame:
        return self.index.filter(F.col("_term") != HEADER)

    def document_table(self) -> DataFrame:
        """(_id, _th, _n): one row a document, with its number of words."""
        return self.index.filter(F.col("_term") == HEADER).select("_id", "_th", "_n")

    def _list(self, rank: int) -> DataFrame:
        """Alignments of the anchors of a rank: the posting less the term's place."""
        own = self.anchors.filter(F.col("_rank") == rank)
        hits = small_join(self.postings(), own, "_term", self.n_anchors)
        return hits.select("_win", "_check", "_len", "_last", "_id", "_th", (F.col("_pos") - F.col("_off")).alias("_start"))

    def alignments(self) -> DataFrame:
        """(_win, _check, _len, _id, _th, _start): places at which the rarest
        terms of a window all stand as in the window."""
        on = ["_win", "_check", "_id", "_th", "_start"]
        found = self._list(0)
        for rank in range(1, LISTS):
            at = self._list(rank)
            both = found.join(at, [found[c].eqNullSafe(at[c]) for c in on], "left_semi")
            found = found.filter(F.col("_last") < rank).unionByName(both)
        return found.select("_win", "_check", "_len", "_id", "_th", "_start").distinct()

    def occurrences(self) -> DataFrame:
        """(_id, _th, _found): documents with exact occurrences of windows, an
        array of (_start, _len, _win, _check) in order of place.

        Documents with an alignment are read again (found by a bounded set of
        hash buckets before anything is shuffled). A document's words stay one
        array, which each of its alignments is compared with in place.
        """
        found = keep(self.alignments())
        per_doc = found.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("_start", "_len", "_win", "_check"))).alias("_at"))
        bucket = F.pmod(F.xxhash64("_id", "_th"), F.lit(1 << 17))
        buckets = found.select(bucket.alias("_bucket")).distinct()
        x = self.docs.select(F.col(self.key).alias("_i"), F.xxhash64(F.col(self.text)).alias("_t"), F.col(self.text).alias("_x")).distinct()
        x = small_join(x.withColumn("_bucket", F.pmod(F.xxhash64("_i", "_t"), F.lit(1 << 17))), buckets, "_bucket", 1 << 17, "left_semi")
        x = x.join(per_doc, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")))
        # a generator of one row: no filter on what follows is moved below it, where words would be split anew each time
        x = x.select("_id", "_th", F.inline(F.array(F.struct(content_words(F.col("_x")).alias("_w"), F.col("_at").alias("_places")))))

        def occurs(a: Column) -> Column:
            # element by element: a slice would copy the whole array each time
            win, check = window_hashes(F.transform(F.sequence(F.lit(0), a["_len"] - 1), lambda i: F.get("_w", a["_start"] + i)))
            inside = (a["_start"] >= 0) & (a["_start"] + a["_len"] <= F.size("_w"))
            return F.when(inside, (win == a["_win"]) & (check == a["_check"])).otherwise(False)

        return x.select("_id", "_th", F.filter("_places", occurs).alias("_found")).filter(F.size("_found") > 0)

    def phrases(self, occurrences: DataFrame | None = None) -> DataFrame:
        """(_id, _th, _item, _start, _len): exact occurrences of the items'
        windows, the place and length in words of the document."""
        x = self.occurrences() if occurrences is None else occurrences
        return small_join(x.select("_id", "_th", F.inline("_found")), self.items, ["_win", "_check"], self.n_items).select(
            "_id", "_th", "_item", "_start", "_len")

    def proximity(self, slack: int = 5) -> DataFrame:
        """(_id, _th, _item, _start, _gap): the rarest and the next rarest term
        of a window stand near each other, up to ``slack`` words off their
        places, but not in them. Starts are joined by blocks of the slack."""
        block = slack + 1
        first = self._list(0).withColumn("_block", F.explode(F.array(*[
            F.floor(F.col("_start") / block) + d for d in (-1, 0, 1)])))
        second = self._list(1).select(F.col("_win").alias("_w2"), F.col("_check").alias("_c2"), F.col("_id").alias("_i2"),
                                      F.col("_th").alias("_t2"), F.col("_start").alias("_start2"),
                                      F.floor(F.col("_start") / block).alias("_b2"))
        gap = F.col("_start2") - F.col("_start")
        near = first.join(second, (F.col("_win") == F.col("_w2")) & (F.col("_check") == F.col("_c2")) & F.col("_id").eqNullSafe(F.col("_i2"))
                          & (F.col("_th") == F.col("_t2")) & (F.col("_block") == F.col("_b2")))
        near = near.filter((F.abs(gap) <= slack) & (gap != 0)).withColumn("_gap", F.abs(gap))
        near = near.groupBy("_win", "_check", "_id", "_th", "_start").agg(F.min("_gap").alias("_gap"))
        return small_join(near, self.items, ["_win", "_check"], self.n_items).groupBy("_id", "_th", "_item", "_start").agg(
            F.min("_gap").alias("_gap"))


def words_inside(found: Column) -> Column:
    """How many words lie inside at least one of the occurrences, which are in
    order of their places: each adds what reaches beyond those before it."""
    zero = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n"))

    def add(done: Column, x: Column) -> Column:
        end = (x["_start"] + x["_len"]).cast("bigint")
        more = F.greatest(end - F.greatest(done["to"], x["_start"].cast("bigint")), F.lit(0).cast("bigint"))
        return F.struct(F.greatest(done["to"], end).alias("to"), (done["n"] + more).alias("n"))

    return F.aggregate(found, zero, add, lambda done: done["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", key: str = "doc_id",
                  item: str = "item_id", item_text: str = "text", share: int = 20) -> DataFrame:
    """One row a document: (_id, _th, n_words, n_hit, items, contaminated). It is
    contaminated when at least one word in ``share`` is inside a window's occurrence."""
    index = PositionalIndex(docs, benchmark, window, text, key, item, item_text)
    found = keep(index.occurrences().withColumn("_hit", words_inside(F.col("_found"))))
    wins = found.select("_id", "_th", F.explode(F.array_distinct(F.transform("_found", lambda x: F.struct(
        x["_win"].alias("_win"), x["_check"].alias("_check"))))).alias("_x")).select("_id", "_th", "_x.*")
    names = small_join(wins, index.items, ["_win", "_check"], index.n_items).groupBy("_id", "_th").agg(
        F.array_sort(F.collect_set(F.col("_item").cast("string"))).alias("_items"))
    hit = found.alias("a").join(names.alias("b"), F.expr("a._id <=> b._id AND a._th = b._th")).select(
        F.col("a._id").alias("_i"), F.col("a._th").alias("_t"), "_hit", "_items")
    out = index.document_table().join(hit, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left")
    hits = F.coalesce("_hit", F.lit(0)).cast("bigint")
    return out.select("_id", "_th", F.col("_n").alias("n_words"), hits.alias("n_hit"),
                      F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
                      ((hits > 0) & (share * hits >= F.col("_n"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    bad = keep(contamination(docs, benchmark, text=text, key=key, **options).filter("contaminated").select("_id", "_th").distinct())
    x = wrapped(docs, _i=F.col(key), _t=F.xxhash64(F.col(text)))
    return unwrapped(small_join(x, bad, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), bad.count(), "left_anti"))
