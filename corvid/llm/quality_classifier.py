"""Quality classifier: boosted trees over statistics of whole documents.

Every text is read once, in Arrow batches, for its statistics, which are
written. The trees are fitted to a bounded sample of labelled rows
(``fit_rows``, the one documented bound); every document is scored from its
statistics by walking the flat arrays of the trees. The model's size depends on
its parameters alone.

Only the text makes a score: not the label, language, source or id.

Defined results: a null or empty text has statistics 0 and a score like any
other; very long texts are counted whole; repeated rows get equal scores; a
document with several labels is a labelled row for each, one whose label is null
isn't labelled; without labels of both classes all scores are the share of
label 1 (one half without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.boosting import BoostedTrees, fit
from corvid.llm.common import stored
from corvid.llm.hashing import BLANK, LOWER, pieces, word_hashes

#: Labelled rows that the trees are fitted to, about; never more than twice as many.
FIT_ROWS = 20_000

STATISTICS = ("log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "beyond_ascii", "stop", "comma", "shout",
              "pipe", "marks", "other_marks", "blank", "line_end", "capital_words", "marked_words", "distinct_words",
              "commonest_word", "repeated_pairs", "repeated_lines", "entropy")


def _class_table() -> np.ndarray:
    """Class of each byte: 0 others, then one a statistic."""
    t = np.zeros(256, np.uint8)
    t[65:91] = 1
    t[48:58] = 2
    t[128:] = 3
    for k, chars in enumerate((b".", b",;:", b"!?", b"|", b"#*$%&<>"), 4):
        t[list(chars)] = k
    for c in range(33, 127):
        if not t[c] and not chr(c).isalnum():
            t[c] = 9
    t[BLANK] = 10
    t[10] = 11
    return t


_CLASS = _class_table()
_CLASSES = 12


def _text_statistics(data: np.ndarray, words: np.ndarray, capital: int, marked: int, longest: int) -> np.ndarray:
    """Statistics of one text (bytes as written) with the hashes of its words."""
    out = np.zeros(len(STATISTICS))
    n, w = len(data), len(words)
    if not n:
        return out
    kinds = np.bincount(_CLASS[data], minlength=_CLASSES)
    seen = np.bincount(data, minlength=256)
    share = seen[seen > 0] / n
    inside = n - kinds[10] - kinds[11]
    out[:4] = np.log1p(n), np.log1p(w), inside / max(w, 1), np.log1p(longest)
    out[4:15] = kinds[1:] / n
    out[15:17] = capital / max(w, 1), marked / max(w, 1)
    if w:
        _, times = np.unique(words, return_counts=True)
        out[17:19] = len(times) / w, times.max() / w
        if w > 1:
            pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
            out[19] = 1 - len(np.unique(pairs)) / len(pairs)
    lines = [x for x in data.tobytes().split(b"\n") if x.strip()]
    out[20] = 1 - len(set(lines)) / max(len(lines), 1)
    out[21] = -(share * np.log2(share)).sum()
    return out


def text_statistics(texts: pa.Array) -> np.ndarray:
    """(texts x statistics) of an Arrow array of strings."""
    out = np.zeros((len(texts), len(STATISTICS)))
    with np.errstate(over="ignore"):
        for at, raw, offsets in pieces(texts, lower=False):
            words, bounds = word_hashes(LOWER[raw], offsets)
            inside = ~BLANK[raw]
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            if len(raw):
                # a word ends with its text
                edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
                first[edges] |= inside[edges]
                last[edges - 1] |= inside[edges - 1]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last)
            lengths = ends - starts + 1
            capital = _CLASS[raw[starts]] == 1
            marked = np.isin(_CLASS[raw[ends]], (4, 5, 6, 7, 8, 9))
            for i in range(len(offsets) - 1):
                a, b = bounds[i], bounds[i + 1]
                out[at + i] = _text_statistics(raw[offsets[i]:offsets[i + 1]], words[a:b], int(capital[a:b].sum()),
                                               int(marked[a:b].sum()), int(lengths[a:b].max(initial=0)))
    return out


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, statistics array<float>) of every document."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(STATISTICS)
        for batch in batches:
            values = text_statistics(batch.column(1)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "statistics"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, statistics array<float>")


def fit_classifier(labelled: DataFrame, fit_rows: int = FIT_ROWS, **options) -> BoostedTrees:
    """Trees from rows of (doc_id, statistics, label). Up to ``fit_rows`` rows
    are all used; of more, those whose hash falls below that share."""
    n = labelled.count()
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", "statistics"), F.lit(1 << 32)) < int(min(1.0, fit_rows / max(n, 1)) * (1 << 32)))
    # the order of the rows decides the last bits of sums
    rows = chosen.select("statistics", "label").limit(2 * fit_rows).toArrow().sort_by([("label", "ascending")])
    values = np.array(rows.column("statistics").to_pylist(), np.float64).reshape(len(rows), len(STATISTICS))
    labels = rows.column("label").to_numpy().astype(float)
    order = np.lexsort((*values.T, labels))
    return fit(values[order], labels[order], **options)


def score_statistics(rows: DataFrame, model: BoostedTrees) -> DataFrame:
    """Add ``score`` (probability of label 1) to rows with ``statistics``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            score = sent.value.chance(flat.reshape(len(batch), len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "statistics").mapInArrow(run, f"doc_id {kind}, score double")


def held_out(key: Column, parts: int = 4, which: int = 2) -> Column:
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % parts == which


def classify_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
                     fit_rows: int = FIT_ROWS, cutoff: float = 0.7, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; rows that are
    held out teach nothing."""
    rows = stored(document_statistics(docs, text, key), "quality-statistics")
    marks = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(key))).select(
        F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label"))
    model = fit_classifier(rows.join(marks, "doc_id"), fit_rows, **options)
    scored = score_statistics(rows, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= cutoff).cast("int").alias("predicted"))
