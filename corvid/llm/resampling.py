"""Draw documents that look like a target set: importance resampling.

Features are runs of words, hashed to buckets. The corpus and the target are
counted by bucket; a bucket's gain is the log ratio of its smoothed shares, an
array of numbers small enough to send to every task. A document's weight is the
mean gain of its features, its score adds Gumbel noise that depends on seed and
id alone, so the highest scores are a sample without replacement by weight.

The scored rows are written once. Exact count jobs over (score, id) narrow an
interval until the cutoff is found; the rows above it are range-partitioned for
their ranks. No row is sorted that isn't drawn.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased.

Defined results: a null or wordless text has no features, weight 0, and can't be
drawn while ``min_words`` is above 0; a null id has the noise of the empty
string and comes last among ties; rows with equal score and id are drawn up to
the exact number, any of them; repeated rows count as often as they occur; no
target text means equal target shares; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corvid.llm.common import stored
from corvid.plans.ordering import with_global_position

#: Probes of one count job: each job cuts the interval to a sixteenth.
PROBES = 15
#: Known words of a task; the memo starts anew beyond.
MEMO_WORDS = 500_000
_LAST_ID = (1 << 63) - 1

_WORD = np.full(256, 32, dtype=np.uint8)
_WORD[128:] = np.arange(128, 256)
_WORD[97:123] = np.arange(97, 123)
_WORD[48:58] = np.arange(48, 58)
_WORD[65:91] = np.arange(97, 123)


class _Buckets(dict):
    """Bucket of a feature, kept once computed."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket


def feature_buckets(buckets: int, most: int) -> Callable[[pa.Scalar], tuple[int, np.ndarray]]:
    """A function from a text to (words, buckets of all runs of 1 to ``most`` words)."""
    known = _Buckets(buckets)

    def of(text: pa.Scalar) -> tuple[int, np.ndarray]:
        raw = text.as_buffer()
        if raw is None:
            return 0, np.zeros(0, np.int64)
        words = _WORD[np.frombuffer(raw, np.uint8)].tobytes().split()
        n = len(words)
        runs = [np.fromiter(map(known.__getitem__, words), np.int64, n)]
        for k in range(2, most + 1):
            grams = (b" ".join(words[i:i + k]) for i in range(n - k + 1))
            runs.append(np.fromiter((known[g] for g in grams), np.int64, max(n - k + 1, 0)))
        return n, np.concatenate(runs)
    return of


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = 10_000, most: int = 1) -> np.ndarray:
    """Features of all texts by bucket. Tasks send one row a bucket they met."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = feature_buckets(buckets, most), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(of(value)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    parts = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    # as many rows as buckets
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    n, s, t = float(len(source)), source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(key: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from the seed and the id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint")


def score_documents(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text",
                    buckets: int = 10_000, most: int = 1, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    gains = bucket_gains(bucket_counts(docs, text, buckets, most), bucket_counts(target, target_text, buckets, most))
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, gain = feature_buckets(buckets, most), sent.value
        for batch in batches:
            n_words, n_features, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for i, value in enumerate(batch.column(1)):
                n_words[i], found = of(value)
                n_features[i] = len(found)
                weight[i] = gain[found].sum() // max(len(found), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _narrow(rows: DataFrame, value: Column, low: int, high: int, wanted: int) -> int:
    """The least x in [low, high] with at most ``wanted`` rows whose value is
    above x. Each round is one job that counts exactly for ``PROBES`` values."""
    while low < high:
        probes = sorted({low + (high - low) * (i + 1) // (PROBES + 1) for i in range(PROBES)})
        counts: Row = rows.agg(*[F.count(F.when(value > p, 1)).alias(f"above_{i}") for i, p in enumerate(probes)]).first()
        enough = [p for p, n in zip(probes, counts) if n <= wanted]
        low = max([low] + [p + 1 for p, n in zip(probes, counts) if n > wanted])
        high = min([high] + enough)
    return low


def draw(scored: DataFrame, wanted: int) -> DataFrame:
    """Add ``rank`` to stored rows of (doc_id, score, drawable): 1, 2, 3... by
    falling score and rising id for exactly ``wanted`` drawable rows, else null.

    First the cutoff score is bisected, then the id among the rows tied there.
    """
    tie = F.coalesce(F.col("doc_id"), F.lit(_LAST_ID))
    able = scored.filter("drawable")
    ends = able.agg(F.min("score"), F.max("score")).first()
    none = scored.withColumn("rank", F.lit(None).cast("bigint"))
    if wanted <= 0 or ends[0] is None:
        return none
    cutoff = _narrow(able, F.col("score"), ends[0] - 1, ends[1], wanted)
    # rows above the cutoff are all drawn, those at the cutoff as far as wanted
    above = able.filter(F.col("score") > cutoff).count()
    tied, missing = able.filter(F.col("score") == cutoff), wanted - above
    ids = tied.agg(F.min(tie), F.max(tie), F.count(F.lit(1))).first()
    last = ids[1]
    if ids[2] > missing:
        # by falling -id: the ids above -last-1 are those up to last
        last = -_narrow(tied, -tie, -ids[1] - 1, -ids[0], missing) - 1
        reached = tied.filter(tie <= last).count()
        if reached < missing:
            # equal rows at the border: the next id is drawn in part
            last = tied.filter(tie > last).agg(F.min(tie)).first()[0]
    taken = F.col("drawable") & ((F.col("score") > cutoff) | ((F.col("score") == cutoff) & (tie <= F.lit(last))))
    ranked = with_global_position(scored.filter(taken), [F.col("score").desc(), tie.asc()], "rank").withColumn("rank", F.col("rank") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(none.filter(~F.coalesce(taken, F.lit(False))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, **options) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document;
    of those with ``min_words`` words ``percent`` in a hundred are drawn and
    ranked. Options are those of ``score_documents``."""
    scored = stored(score_documents(docs, target, **options).withColumn("drawable", F.col("n_words") >= min_words), "resampling")
    wanted = percent * scored.filter("drawable").count() // 100
    return draw(scored, wanted).drop("drawable")
