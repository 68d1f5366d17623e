"""64-bit hashes of words and shingles, on whole Arrow batches at a time.

Used inside tasks. Hashes are the same on every machine. Texts are handled in
pieces of whole documents of about a megabyte, so memory is bounded by the
longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def pieces(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows, A-Z lower-cased or as they
    are; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        to = min(to, len(texts))
        part = data[offsets[at]:offsets[to]]
        yield at, LOWER[part] if lower else part, (offsets[at:to + 1] - offsets[at]).astype(np.int64)
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end) of a piece: A-Z
    lower-cased words between blanks, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~BLANK[data]
    first = np.ones(n, bool)
    first[1:] = ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(inside & first)
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    last[ends_at] = True
    ends = np.flatnonzero(inside & last) + 1
    power, inverse = _power_tables(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=run[1:])
    raw = (run[ends] - run[starts]) * inverse[starts]
    words = mix(raw + (ends - starts).astype(np.uint64) * _PLACE[7])
    return words, np.searchsorted(starts, offsets)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each row; a row of fewer words,
    but not none, has its whole sequence as one."""
    n = len(words)
    if n >= k:
        total = words[:n - k + 1] * _PLACE[0]
        for j in range(1, k):
            total = total + words[j:n - k + 1 + j] * _PLACE[j]
        shingles = mix(total)
    else:
        shingles = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(shingles[a:b - k + 1]))
        elif b > a:
            part = words[a:b] * _PLACE[:b - a]
            out.append(mix(np.array([part.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(values: np.ndarray) -> int:
    """A signed 64-bit number that stands for a set."""
    total = mix(values * _PLACE[5]).sum(dtype=np.uint64) + np.uint64(len(values)) * _PLACE[6]
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
