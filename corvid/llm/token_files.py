"""Token-ID files: independent zstandard frames and a trailing seek table.

A file holds the token ids of consecutive documents as little-endian unsigned
32-bit integers. Whole documents are packed into frames that decompress on
their own; the frames are followed by a skippable frame with the document
index and by the seek table of zstandard's seekable format, which has every
frame's sizes and the checksum (lower 32 bits of XXH64) of its content. A
reader takes the table from the end of the file and decompresses the frames
of the documents it wants.

Spark writes the files (one row of bytes each, through the commit protocol of
its text writer, so a lost task leaves no file) and reads them as binary files.
A row's line separator is the one byte that ends every seek table.

Defined results: a null or empty text has only the end id; a null id comes
first; rows with equal ids are written one after the other; an empty table
gives no documents.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm.common import keep, small_join

# Fixed values of the zstandard and seekable formats.
INDEX_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")
#: The last byte of FOOTER_MAGIC in a file; Spark writes it after each row.
LAST_BYTE = "\x8f"

FRAME_BYTES = 1 << 18
FILE_BYTES = 16 << 20
#: Pieces whose ids a worker remembers, and those that the library is given at once.
MEMO_PIECES = 400_000
LEARNED_PIECES = 4000
#: Texts of ASCII without apostrophe, control or special-token marks, and of Latin-1 letters.
PLAIN = re.compile(r"(?:[ \t\n\r!-&(-~À-ÖØ-öø-ÿ])*")
# The normaliser and the splitter of a tokenizers file that cuts plain texts into runs of
# letters, single digits and runs of other marks after lower-casing them.
LOWER_CASED = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
RUNS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

#: What a Latin-1 byte of a lower-cased plain text is: 0 blank, 1 letter, 2 digit, 3 other.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[9, 10, 13, 32]] = 0
_KIND[97:123] = 1
_KIND[0xDF:] = 1
_KIND[48:58] = 2


def cuts_plain_texts(path: str) -> bool:
    """Whether the file is known to cut plain texts as ``Encoder`` does."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    marks = [x["content"] for x in rules.get("added_tokens") or []]
    return (rules.get("normalizer") == LOWER_CASED and rules.get("pre_tokenizer") == RUNS and not rules.get("truncation")
            and not rules.get("padding") and all(m.startswith("<|") for m in marks))


class Encoder:
    """Texts to ids with a tokenizers file.

    The library takes most of its time for normalising and splitting. Where a
    file's rules for that are those of ``LOWER_CASED`` and ``RUNS``, a plain
    text (see PLAIN) is split here, on arrays of bytes, and the library encodes
    each new piece, whose ids are remembered. Any other text, and any text with
    any other file, goes through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.splits = cuts_plain_texts(path)
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        """No piece is known: the ids of piece k are ids[starts[k]:starts[k + 1]]."""
        self.memo: dict[bytes, int] = {}
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        """Many pieces are one text to the library, a line each, whose tokens say which line they are from."""
        ids, sizes = [self.ids], []
        for at in range(0, len(pieces), LEARNED_PIECES):
            part = pieces[at:at + LEARNED_PIECES]
            found = self.pieces.encode(b"\n".join(part).decode("latin-1"), add_special_tokens=False)
            ids.append(np.asarray(found.ids, "<u4"))
            sizes.append(np.bincount(np.asarray(found.word_ids, np.int64), minlength=len(part)))
        self.memo.update(zip(pieces, range(len(self.memo), len(self.memo) + len(pieces))))
        self.ids = np.concatenate(ids)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])

    def _plain(self, texts: list[str]) -> list[bytes]:
        lengths = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer("\n".join(t.lower() for t in texts).encode("latin-1"), np.uint8)
        kind = _KIND[raw]
        inside = kind != 0
        change = np.ones(len(raw) + 1, bool)
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts, ends = np.flatnonzero(change[:-1] & inside), np.flatnonzero(change[1:] & inside) + 1
        # blanks aside, pieces lie one after the other
        at = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=at[1:])
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[inside])]).dictionary_encode()
        _, bounds, data = pieces.dictionary.buffers()
        bounds, data = np.frombuffer(bounds, np.int32)[:len(pieces.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
        distinct = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        if len(self.memo) > MEMO_PIECES:
            self._forget()
        if new := [p for p in distinct if p not in self.memo]:
            self._learn(new)
        number = np.array([self.memo[p] for p in distinct], np.int64)[pieces.indices.to_numpy()]
        first, size = self.starts[number], self.starts[number + 1] - self.starts[number]
        done = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=done[1:])
        ids = self.ids[np.repeat(first - done[:-1], size) + np.arange(done[-1])]
        edges = done[np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths + 1)]))]
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        plain = [self.splits and "<|" not in t and PLAIN.fullmatch(t) is not None for t in texts]
        out: list[bytes] = [b""] * len(texts)
        if own := [i for i, p in enumerate(plain) if p]:
            for i, ids in zip(own, self._plain([texts[i] for i in own])):
                out[i] = ids
        if others := [i for i, p in enumerate(plain) if not p]:
            for i, e in zip(others, self.whole.encode_batch_fast([texts[i] for i in others], add_special_tokens=False)):
                out[i] = np.asarray(e.ids, dtype="<u4").tobytes()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file. A task has a core, so the
    library is kept from threads of its own, which spin while they wait."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class FileBuilder:
    """Collects documents into frames, and gives the bytes of a file."""

    def __init__(self):
        import zstandard
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.frames: list[bytes] = []
        self.entries: list[tuple[int, int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0
        self.index: list[tuple[bool, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id is not None, doc_id or 0, len(ids) // 4, len(self.frames)))
        self.open.append(ids)
        self.open_bytes += len(ids)
        if self.open_bytes >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            import xxhash
            raw = b"".join(self.open)
            frame = self.pack(raw)
            self.frames.append(frame)
            self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        """The file without its last byte."""
        self.flush()
        known, ids, sizes, frames = zip(*self.index)
        index = self.pack(struct.pack("<Q", len(ids)) + np.asarray(known, "u1").tobytes() + np.asarray(ids, "<i8").tobytes()
                          + np.asarray(sizes, "<u4").tobytes() + np.asarray(frames, "<u4").tobytes())
        index = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        entries = [*self.entries, (len(index), 0, 0)]
        table = b"".join(struct.pack("<III", *e) for e in entries) + FOOTER.pack(len(entries), CHECKSUM_FLAG, FOOTER_MAGIC)
        return (b"".join([*self.frames, index]) + struct.pack("<II", SEEK_MAGIC, len(table)) + table)[:-1]


def build_files(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Sorted (id, text) to files of bounded size; works on a megabyte or so of text at a time."""
    encode, end, file = encoder(path).encode, struct.pack("<I", end_id), FileBuilder()

    def row(data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["content"])

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        at = 0
        while at < len(ids):
            part, size = [], 0
            while at + len(part) < len(ids) and size < 1 << 20:
                part.append(texts[at + len(part)].as_py() or "")
                size += len(part[-1])
            for doc_id, encoded in zip(ids[at:], encode(part)):
                file.add(doc_id, encoded + end)
                if file.bytes >= FILE_BYTES:
                    yield row(file.finish())
                    file = FileBuilder()
            at += len(part)
    if file.index:
        yield row(file.finish())


def write_tokens(docs: DataFrame, out: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 1) -> None:
    """Write the documents' ids to ``out`` in the order of their ids: range
    partitions sorted by id, a file of 16 MB or a partition each."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    files = ordered.mapInArrow(lambda batches: build_files(batches, tokenizer, end_id), "content binary")
    (files.select(F.col("content").cast("string").alias("value")).write.option("lineSep", LAST_BYTE)
     .option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(out))


class FileReader:
    """A file's documents; ``read`` decompresses only frames that it needs."""

    def __init__(self, data: bytes):
        import zstandard
        self.data, self.unpack = data, zstandard.ZstdDecompressor().decompress
        n, flag, magic = FOOTER.unpack(data[-FOOTER.size:])
        if magic != FOOTER_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        self.table = np.frombuffer(data, "<u4", 3 * n, len(data) - FOOTER.size - 12 * n).reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        raw = self.unpack(data[self.at[n - 1] + 8:self.at[n]])
        k = struct.unpack_from("<Q", raw)[0]
        self.known = np.frombuffer(raw, "u1", k, 8)
        self.ids = np.frombuffer(raw, "<i8", k, 8 + k)
        self.sizes = np.frombuffer(raw, "<u4", k, 8 + 9 * k).astype(np.int64)
        self.frames = np.frombuffer(raw, "<u4", k, 8 + 13 * k)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def read(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, place of the first token in the file, ids) of the documents."""
        import xxhash
        last, raw, first = -1, b"", 0
        for i in range(len(self.ids)):
            doc_id = int(self.ids[i]) if self.known[i] else None
            if wanted is not None and doc_id not in wanted:
                continue
            frame = int(self.frames[i])
            if frame != last:
                raw = self.unpack(self.data[self.at[frame]:self.at[frame + 1]], max_output_size=int(self.table[frame, 1]))
                if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[frame, 2]:
                    raise ValueError(f"frame {frame}: wrong checksum")
                last, first = frame, int(self.starts[np.searchsorted(self.frames, frame)])
            at = 4 * (int(self.starts[i]) - first)
            yield doc_id, int(self.starts[i]), raw[at:at + 4 * int(self.sizes[i])]


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, file, place, n_tokens, ids_crc32, ids) from written files: of
    all documents, or of some, for which only their frames are decompressed."""
    wanted = None if doc_ids is None else set(doc_ids)
    fields = [("doc_id", pa.int64()), ("file", pa.string()), ("place", pa.int64()), ("n_tokens", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                if not data:
                    continue
                found = [(i, place, len(ids) // 4, zlib.crc32(ids), ids) for i, place, ids in FileReader(data).read(wanted)]
                cols = [[f[0] for f in found], [name.as_py()] * len(found), *[[f[k] for f in found] for k in (1, 2, 3, 4)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

    kinds = "doc_id bigint, file string, place bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, kinds)


def token_starts(read: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before. Files are in the order
    of their partition and their number in it; only their totals are summed up."""
    rows = keep(read.drop("ids").withColumns({
        "_part": F.regexp_extract("file", r"part-(\d+)-", 1).cast("bigint"),
        "_nth": F.regexp_extract("file", r"-c(\d+)\.", 1).cast("bigint")}))
    totals = rows.groupBy("_part", "_nth").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("_part", "_nth").rowsBetween(Window.unboundedPreceding, -1)
    first = keep(totals.select("_part", "_nth", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    x = small_join(rows, first, ["_part", "_nth"], first.count())
    return x.withColumn("start", F.col("_first") + F.col("place")).drop("_part", "_nth", "_first")


def tokenize_corpus(docs: DataFrame, out: str, tokenizer: str, **options) -> DataFrame:
    """Write all documents to ``out`` and return what the files then hold."""
    write_tokens(docs, out, tokenizer, **options)
    return token_starts(read_tokens(docs.sparkSession, out, with_ids=False))
