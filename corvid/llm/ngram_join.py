"""N-gram Jaccard join by filters under several global token orders.

A document is the set of its distinct five-word shingles (64-bit hashes).
Sets that reach the threshold t must share a token among the first
``n - ceil(t n) + 1`` of each, under any order of all tokens. Three orders are
used, and a pair must pass all of them before its sets are intersected:

1. ascending hash, with a prefix of a third of the set: a set that has fewer
   shared tokens in that prefix than any partner guarantees has no link and is
   left out (``least_shared``);
2. rarest first among the sets left, by a count of their tokens in buckets:
   sets whose prefixes share a token, at places where enough tokens follow, are
   candidates;
3. descending hash (and ascending again), on each candidate pair.

The classes are what the links connect. Equal sets are one node. A list of
sets with a common prefix token is not turned into all its pairs: each round
pairs every set with one pivot, links join classes, and only pairs of sets
whose classes still differ are then enumerated, as far as the parities of their
tokens let them reach the threshold, so no link between classes is missed.

Defined results: a null, empty or blank text has an empty set, which links
with nothing; documents with equal sets are linked (repeated rows too); a
class is named by its least id, null only where it has no other; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm.common import deleted, keep, shared_path, small_join, sweep, unwrapped, wrapped
from corvid.llm.hashing import mix, pieces, set_id, shingle_sets, word_hashes

#: log2 of the bits that mark shared tokens (16 MB for the driver and each worker);
#: tokens are told apart by KEY_BITS when they are found to be shared.
MARK_BITS = 27
KEY_BITS = 32
MARK_WORD = 1 << 15
#: log2 of the token counts of the second order, at most (64 MB).
COUNT_BITS = 24
COUNT_CHUNK = 1 << 14
#: Bits of a set's parities, which bound how far two sets are apart.
PARITY_BITS = 1024
#: Rounds of one pivot a set before the remaining pairs are enumerated, at most.
PIVOT_ROUNDS = 6
#: No further round where one in so many tests or fewer gave a link and the lists
#: are so short on average over their rows: enumerating them is linear.
FEW_LINKS = 32
SHORT_LIST = 16


def prefix_size(n, percent: int = 75):
    """n - ceil(t n) + 1, for numbers and columns of whole numbers."""
    return n - -((-n * percent) // 100) + 1


def wide_prefix(n: int, percent: int) -> int:
    """A longer prefix, in which more than one token must be shared."""
    return min(n, max(prefix_size(n, percent), -(-n * (109 - percent) // 100)))


@lru_cache(maxsize=1 << 16)
def least_shared(n: int, percent: int) -> int:
    """Tokens that a set of n has in common, within both wide prefixes, with any
    set that it links with. Of o common tokens the i-th lies at most at place
    i + n - o in one set and at i + n' - o in the other, so a wide prefix of w
    holds w - (n - o) of them at least; the partner's may hold fewer."""
    sizes = np.arange(-(-n * percent // 100), 100 * n // percent + 1)
    overlap = -(-percent * (n + sizes) // (100 + percent))
    wide = np.minimum(sizes, np.maximum(prefix_size(sizes, percent), -(-sizes * (109 - percent) // 100)))
    fits = overlap <= np.minimum(n, sizes)
    return int(np.minimum(wide_prefix(n, percent) - (n - overlap), wide - (sizes - overlap))[fits].min())


def _sets(batches, k: int):
    """(ids, sorted sets) of each batch."""
    np.seterr(over="ignore")
    for batch in batches:
        found = []
        for _, data, offsets in pieces(batch.column(1)):
            found += shingle_sets(*word_hashes(data, offsets), k)
        yield batch.column(0), found


def members(docs: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """(doc, sid, n): every document's set id and size."""
    def run(batches):
        for ids, found in _sets(batches, k):
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array([set_id(s) for s in found], pa.int64()),
                 pa.array([len(s) for s in found], pa.int64())], names=["doc", "sid", "n"])
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, "doc bigint, sid bigint, n bigint")


def prefix_keys(docs: DataFrame, text: str, key: str, k: int, percent: int) -> DataFrame:
    """(sid, keys): the wide prefix under ascending hash of every non-empty set
    (once a task), each token by its upper bits."""
    def run(batches):
        seen = set()
        for _, found in _sets(batches, k):
            new = {set_id(s): s for s in found if len(s)}
            new = {sid: s for sid, s in new.items() if sid not in seen}
            seen.update(new)
            keys = [(s[:wide_prefix(len(s), percent)] >> np.uint64(64 - KEY_BITS)).astype(np.uint32).view(np.int32) for s in new.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(new), pa.int64()), pa.array(keys, pa.list_(pa.int32()))], names=["sid", "keys"])
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, "sid bigint, keys array<int>")


def shared_marks(prefixes: DataFrame) -> np.ndarray:
    """Bits of the buckets of tokens that lie in the prefixes of two or more
    different sets (a bit may be set for no reason, never missing). Per key only
    the least and the greatest of its sets' ids are kept, so copies and frequent
    tokens shrink before the shuffle; the result's size is fixed."""
    rows = prefixes.select("sid", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).filter("a <> b")
    bucket = F.shiftrightunsigned(F.col("key").cast("bigint").bitwiseAND((1 << KEY_BITS) - 1), KEY_BITS - MARK_BITS)
    marks = shared.select(bucket.alias("bucket")).groupBy(F.shiftright("bucket", 15).alias("word")).agg(
        F.bitmap_construct_agg(F.col("bucket") % MARK_WORD).alias("bits")).collect()
    out = np.zeros((1 << MARK_BITS) // 8, np.uint8)
    for r in marks:
        out[r["word"] * MARK_WORD // 8:(r["word"] + 1) * MARK_WORD // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def linkable_sets(docs: DataFrame, sent: Broadcast, text: str, key: str, k: int, percent: int) -> DataFrame:
    """(sid, n, tokens) of the sets with enough shared tokens (marked in the
    bits that are sent) in the wide prefix. A task gives equal sets once; the
    steps below bear it that several tasks give the same set."""

    def run(batches):
        bits, seen = sent.value, set()
        for _, found in _sets(batches, k):
            out = []
            for s in found:
                if not len(s):
                    continue
                prefix = s[:wide_prefix(len(s), percent)]
                at = prefix >> np.uint64(64 - MARK_BITS)
                shared = np.count_nonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                if shared >= least_shared(len(s), percent):
                    sid = set_id(s)
                    if sid not in seen:
                        seen.add(sid)
                        out.append((sid, len(s), s.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["sid", "n", "tokens"])

    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "sid bigint, n bigint, tokens array<bigint>")


def _tokens(column) -> list[np.ndarray]:
    return [v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in column]


def token_counts(sets: DataFrame, bits: int) -> np.ndarray:
    """How many of the sets' tokens fall into each of 2 ** bits hash buckets."""
    def count(batches):
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for s in _tokens(batch.column(0)):
                np.add.at(total, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
        # a part of the buckets at a time, and only those that are not empty
        for i, part in enumerate(total.reshape(-1, COUNT_CHUNK)):
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                     pa.array([part[at].tobytes()], pa.binary())], names=["part", "places", "counts"])

    def add(frame):
        total = np.zeros(COUNT_CHUNK, np.int64)
        for places, counts in zip(frame["places"], frame["counts"]):
            total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int32)
        total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return frame.head(1)[["part"]].assign(counts=[total.tobytes()])

    parts = sets.select("tokens").mapInArrow(count, "part bigint, places binary, counts binary")
    out = np.zeros(1 << bits, np.int32).reshape(-1, COUNT_CHUNK)
    for r in parts.groupBy("part").applyInPandas(add, "part bigint, counts binary").collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.int32)
    return out.reshape(-1)


def count_bits(sets: DataFrame) -> int:
    """log2 of the buckets for the sets' tokens: they grow with the tokens up to a fixed bound."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    return max(16, min(COUNT_BITS, int(total).bit_length() - 2))


def rare_prefixes(sets: DataFrame, sent: Broadcast, bits: int, percent: int) -> DataFrame:
    """(token, sid, n, place): the prefixes under the order rarest first (by
    the count of the token's bucket, which is sent, then hash). Any order of
    all tokens is right."""

    def run(batches):
        counts = sent.value
        for batch in batches:
            out = []
            for s in _tokens(batch.column(1)):
                order = np.lexsort((s, counts[(s >> np.uint64(64 - bits)).astype(np.int64)]))
                out.append(s[order[:prefix_size(len(s), percent)]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in batch.column(1)], pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                names=["sid", "n", "prefix"])

    rows = sets.select("sid", "tokens").mapInArrow(run, "sid bigint, n bigint, prefix array<bigint>")
    return rows.select("sid", "n", F.posexplode("prefix").alias("place", "token"))


def _enough(percent: int):
    """Sizes and places of a common token leave room for the overlap needed."""
    need = F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100.0 + percent) - 1e-9)
    left = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    return (left >= need) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))


def parities(sets: DataFrame) -> DataFrame:
    """(sid, bits): per set, the parity of its tokens in each of 1024 buckets, as
    sixteen numbers. Two sets differ in at least as many tokens as bits."""
    def run(batches):
        for batch in batches:
            out = [np.packbits(np.bincount((mix(s) & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1)
                   .view(np.int64) for s in _tokens(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["sid", "bits"])
    return sets.select("sid", "tokens").mapInArrow(run, "sid bigint, bits array<bigint>").dropDuplicates(["sid"])


def _may_reach(percent: int):
    """The parities leave room for the threshold: a bound, so no link is lost."""
    apart = sum(F.bit_count(F.get("a.bits", F.lit(i)).bitwiseXOR(F.get("b.bits", F.lit(i)))) for i in range(PARITY_BITS // 64))
    return apart * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)


def linked(pairs: DataFrame, count: int, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), ``count`` rows, whose sets reach the threshold. The sets of
    the b side travel to the a side; both hash orders are tried before the full overlap."""
    if not count:
        return pairs
    left = sets.join(pairs.select("a").distinct().withColumnRenamed("a", "sid"), "sid", "left_semi")
    right = small_join(sets.withColumnRenamed("sid", "b"), pairs, "b", count)
    both = right.select("a", "b", F.col("tokens").alias("tb")).join(
        left.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a")

    def run(batches):
        for batch in batches:
            ta, tb = batch.column(2), batch.column(3)
            ok = []
            for x, y in zip(_tokens(ta), _tokens(tb)):
                px, py = prefix_size(len(x), percent), prefix_size(len(y), percent)
                good = (np.intersect1d(x[:px], y[:py], True).size and np.intersect1d(x[-px:], y[-py:], True).size)
                if good:
                    both = np.intersect1d(x, y, True).size
                    good = 100 * both >= percent * (len(x) + len(y) - both)
                ok.append(bool(good))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return keep(both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint"))


def classes(edges: DataFrame) -> DataFrame:
    """(sid, label): the least id that each end of an edge reaches, by large-star
    and small-star steps until every node is an end of its class's star or its
    centre, which a further step would leave as it is."""
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # a node that has two edges as the greater end, or is the greater end of one and the lesser of another
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("n")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("n")))
        ends = ends.groupBy("x").agg(F.sum("n").alias("n"), F.min("n").alias("lo"))
        if ends.filter("n > 1 or (n = 1 and lo = 0)").isEmpty():
            break
        # large star: the greater neighbours of u go to the least one (or u)
        two = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = two.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the lesser neighbours of u and u go to the least one
        small = big.filter("u <> v").distinct()
        low = small.groupBy("u").agg(F.min("v").alias("m"))
        moved = small.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        del ends, two, least, big, small, low, moved
        sweep(edges.sparkSession)
    return now.select(F.col("u").alias("sid"), F.col("v").alias("label"))


def _labelled(lists: DataFrame, labels: DataFrame | None, count: int) -> DataFrame:
    """The lists with the label of each set; ``labels`` has ``count`` rows."""
    if labels is None:
        return lists.withColumn("label", F.col("sid"))
    return small_join(lists, labels, "sid", count, "left").withColumn("label", F.coalesce("label", "sid"))


def _moved(labels: DataFrame | None, count: int, found: DataFrame) -> DataFrame:
    """Labels after links (a, b): b takes the label that a had. Sets with one
    label are connected; the converse is left to ``classes``."""
    new = found.dropDuplicates(["b"]).select(F.col("a").alias("sid"), "b")
    new = _labelled(new, labels, count).select(F.col("b").alias("sid"), "label")
    if labels is None:
        return keep(new)
    return keep(new.unionByName(labels.join(new.select("sid"), "sid", "left_anti")))


def _written(lists: DataFrame) -> tuple[str, DataFrame]:
    """The lists as a table of their own, and where it is."""
    path = shared_path(lists.sparkSession, "ngram-lists")
    lists.write.parquet(path)
    return path, lists.sparkSession.read.parquet(path)


def set_classes(sets: DataFrame, percent: int) -> DataFrame:
    """(sid, label) of the sets with links, from candidates to classes.

    In a round each list has one pivot, and each set is tested with the pivot
    of another label that it shares most prefix tokens with. Lists of one label
    drop out. The rounds end when they hardly link and the lists are short; what
    is left is enumerated across classes.

    A step without lists, pairs or links is not run on empty frames: every
    exchange and broadcast is a thread of the driver for the next minute, so on
    small inputs, where steps are quick, its memory follows the number of steps.
    """
    spark, bits = sets.sparkSession, count_bits(sets)
    sent = spark.sparkContext.broadcast(token_counts(sets, bits))
    path, lists = _written(rare_prefixes(sets, sent, bits, percent))
    sent.destroy()
    edges = labels = None
    count = 0
    for turn in range(PIVOT_ROUNDS):
        at = _labelled(lists, labels, count)
        # one exchange a round: a list's pivot and labels are found where its rows meet
        of_list = Window.partitionBy("token")
        at = at.withColumns({"p": F.min_by(F.struct("sid", "n", "place", "label"), F.xxhash64("sid", F.lit(turn))).over(of_list),
                             "lo": F.min("label").over(of_list), "hi": F.max("label").over(of_list),
                             "length": F.count(F.lit(1)).over(of_list)})
        old, (path, at) = path, _written(at.filter("lo <> hi").drop("lo", "hi"))
        deleted(spark, old)
        lists = at.drop("p", "label", "length")
        rows, lengths = at.agg(F.count(F.lit(1)), F.sum("length")).first()
        if not rows:
            break
        near = at.filter("p.label <> label").select(F.struct("sid", "n", "place").alias("b"), F.col("p").alias("a"))
        counted = near.filter(_enough(percent)).groupBy(F.col("b.sid").alias("b"), F.col("a.sid").alias("a")).agg(
            F.count(F.lit(1)).alias("c"))
        pairs = keep(counted.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b"))
        tested = pairs.count()
        found = linked(pairs, tested, sets, percent)
        links = found.count()
        if links:
            edges = found if edges is None else edges.unionByName(found)
            labels = _moved(labels, count, found)
            count = labels.count()
        del at, near, counted, pairs, found
        sweep(spark)
        if links * FEW_LINKS <= tested and lengths <= SHORT_LIST * rows:
            break
    stars = classes(edges) if edges is not None else spark.createDataFrame([], "sid bigint, label bigint")
    sweep(spark)
    at = _labelled(lists, stars, stars.count())
    mixed = keep(at.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token"))
    if mixed.isEmpty():
        deleted(spark, path)
        return stars
    signs = keep(parities(sets))
    old, (path, at) = path, _written(small_join(at.join(mixed, "token", "left_semi"), signs, "sid", signs.count()))
    deleted(spark, old)
    rest = at.alias("a").join(at.alias("b"), "token").filter(
        (F.col("a.sid") < F.col("b.sid")) & (F.col("a.label") != F.col("b.label")) & _enough(percent) & _may_reach(percent))
    pairs = keep(rest.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct())
    deleted(spark, path)
    found = linked(pairs, pairs.count(), sets, percent)
    if found.isEmpty():
        return stars
    # what the rounds have linked is in the stars: only the last links are new
    return classes(stars.select(F.col("sid").alias("a"), F.col("label").alias("b")).unionByName(found))


def class_members(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc, sid, n, label): every document's set, its size and its class."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(shared_marks(prefix_keys(docs, text, key, k, percent)))
    sets = keep(linkable_sets(docs, sent, text, key, k, percent))
    sent.destroy()
    sweep(spark)
    labels = set_classes(sets, percent)
    sweep(spark)
    own = keep(members(docs, text, key, k))
    return own.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def similarity_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc, n, component): a row per document, its set's size and the least
    id of the documents that it is linked with, directly or not."""
    named = class_members(docs, text, key, k, percent)
    least = named.filter("n > 0").groupBy("label").agg(F.min("doc").alias("least"))
    linked_rows = named.filter("n > 0").join(least, "label").select("doc", "n", F.col("least").alias("component"))
    return linked_rows.unionByName(named.filter("n = 0").select("doc", "n", F.col("doc").alias("component")))


def one_per_class(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 75) -> DataFrame:
    """One document of each group of near copies, with its own columns: of the
    rows with the least id the one with the least set id, and one row where
    that is repeated. A row's fate hangs on its id and its set, so an id with
    two texts may keep one. Documents with an empty set or a null id stay, all
    their rows."""
    named = class_members(docs, text, key, k, percent).filter("doc is not null")
    pairs = named.groupBy("label", "doc", "sid", "n").agg(F.count(F.lit(1)).alias("rows"))
    least = named.filter("n > 0").groupBy("label").agg(F.min(F.struct("doc", "sid")).alias("least"))
    first = (F.col("doc") == F.col("least.doc")) & (F.col("sid") == F.col("least.sid"))
    pairs = keep(pairs.join(least, "label", "left").select("doc", "sid", "n", "rows", ((F.col("n") == 0) | first).alias("stays")))
    ids = pairs.groupBy("doc").agg(F.max("stays").alias("some"), F.min("stays").alias("every"),
                                   F.max(F.col("stays") & (F.col("n") > 0) & (F.col("rows") > 1)).alias("repeated"))
    gone = keep(ids.filter("not some").select(F.col("doc").alias("_gone")))
    rows = small_join(wrapped(docs, _doc=F.col(key), _text=F.col(text)), gone, F.col("_doc") == F.col("_gone"), gone.count(), "left_anti")
    # ids of which some rows stay and others go: the rows' sets decide
    mixed = keep(ids.filter("some and (repeated or not every)").select(F.col("doc").alias("_mixed")))
    count = mixed.count()
    if not count:
        return unwrapped(rows)

    @F.arrow_udf("bigint")
    def sid_of(texts: pa.Array) -> pa.Array:
        return pa.array([set_id(s) for _, found in _sets([pa.record_batch([texts, texts], ["id", "text"])], k) for s in found], pa.int64())

    on = F.col("_doc") == F.col("_mixed")
    apart = small_join(rows, mixed, on, count, "left_semi").withColumn("_sid", sid_of("_text"))
    apart = apart.join(pairs.filter("stays"), (F.col("_doc") == F.col("doc")) & (F.col("_sid") == F.col("sid")))
    one = apart.filter("n > 0").groupBy("doc", "sid").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")
    kept = small_join(rows, mixed, on, count, "left_anti").select("_row")
    return unwrapped(kept.unionByName(one).unionByName(apart.filter("n = 0").select("_row")))
