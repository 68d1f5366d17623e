"""Byte-level column expressions: byte arrays, checksums, deflate symbol math."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values from the deflate / zlib formats.
ADLER_MOD = 65521
WINDOW = 32768
MIN_MATCH = 3
MAX_MATCH = 258
MASTER_BLOCK = 1_000_000


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def byte_values(blob: Column) -> Column:
    """BINARY -> ARRAY<INT> of byte values (0..255), linear in the blob size."""
    pairs = F.regexp_extract_all(F.hex(blob), F.lit(".."), 0)
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def characters(text: Column) -> Column:
    """STRING -> ARRAY<STRING> of its characters (code points)."""
    return F.split(text, "")


def character(code: Column) -> Column:
    """Code point (INT) -> the character."""
    four = F.lpad(F.hex(code), 8, "0")
    return F.decode(F.unhex(four), "UTF-32")


def adler32(blob: Column) -> Column:
    """Adler-32 of a BINARY, one pass over its bytes with modular sums."""
    init = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))

    def step(acc, x):
        a = (acc["a"] + x) % ADLER_MOD
        return F.struct(a.alias("a"), ((acc["b"] + a) % ADLER_MOD).alias("b"))
    return F.aggregate(byte_values(blob), init, step, lambda acc: acc["b"] * F.lit(65536) + acc["a"])


ADLER_CHUNK = 1 << 20


def _adler32_np(data: bytes) -> int:
    """Adler-32 via the chunked closed form: for a chunk y of m bytes entered
    with sums (a, b): b += m*a + sum((m - i) * y_i), a += sum(y), modulo
    65521. Chunks keep every partial sum inside int64."""
    a, b = 1, 0
    arr = np.frombuffer(data, dtype=np.uint8)
    for start in range(0, len(arr), ADLER_CHUNK):
        y = arr[start:start + ADLER_CHUNK].astype(np.int64)
        m = len(y)
        weights = np.arange(m, 0, -1, dtype=np.int64)
        b = (b + m * a + int((weights * y).sum())) % ADLER_MOD
        a = (a + int(y.sum())) % ADLER_MOD
    return b * 65536 + a


def adler32_vectorized(blob: Column) -> Column:
    """Z14 for corpus-sized blobs: same value as ``adler32``, computed per
    Arrow batch with numpy instead of folding every byte through an
    interpreted higher-order function."""
    @F.pandas_udf("bigint")
    def adler(s: pd.Series) -> pd.Series:
        return s.map(lambda v: _adler32_np(bytes(v)) if v is not None else None).astype("Int64")
    return adler(blob)


def crc32(blob: Column) -> Column:
    """CRC-32 (the zlib / PNG polynomial)."""
    return F.crc32(blob)


def distance_bucket(dist: Column) -> Column:
    """Deflate distance symbol (0..29) of a back-reference distance."""
    d1 = dist - 1
    lvl = F.length(F.bin(d1)) - 1
    return (F.when(dist < 5, d1)
            .otherwise(lvl * 2 + F.call_function("shiftright", d1, lvl - 1).bitwiseAND(F.lit(1)))).cast("int")


def distance_extra_bits(dist: Column) -> Column:
    """Number of extra bits that follow the distance symbol."""
    lvl = F.length(F.bin(dist - 1)) - 1
    return F.when(dist < 5, F.lit(0)).otherwise(lvl - 1).cast("int")


def percent_removed(in_size: Column, out_size: Column) -> Column:
    """100 * (in - out) / in, 3 decimals; NULL for an empty input."""
    return F.round(F.try_divide(F.lit(100.0) * (in_size - out_size), in_size), 3)


def percent_of_original(in_size: Column, out_size: Column) -> Column:
    return F.round(F.try_divide(out_size * F.lit(100.0), in_size), 3)


def kib(size: Column) -> Column:
    return F.floor(size / 1024).cast("bigint")
