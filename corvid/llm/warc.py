"""WARC: derivative builder.

Response records become two linked records each: a metadata record (title,
language, charset, outlinks, the HTTP headers of the source) and a conversion
record (the plain text). Both carry WARC-Refers-To with the response's
identifier, its target URI and date; the metadata names the conversion as
concurrent to it, and keeps the source's payload digest; each has a digest of
its own block.

Files are WARC/1.1 with one gzip member a record and a bounded size. Spark
writes a file's bytes as one row through its text writer (whose separator is
the zero byte that ends a gzip member), so a lost task leaves no file, and
reads them as binary files; records are parsed within the tasks.

Defined results: a null page is an empty payload, with an empty text; a null
URL or id has no field and comes back null; control characters in a URL are
percent-encoded; equal rows give equal records; an empty table gives no files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
FILE_BYTES = 16 << 20
LAST_BYTE = "\x00"

# Elements whose content is no text, and those that end a line.
HIDDEN = frozenset(("script", "style", "template", "noscript"))
BLOCKS = frozenset(("address", "article", "aside", "blockquote", "br", "div", "dd", "dl", "dt", "footer", "h1", "h2", "h3", "h4", "h5",
                    "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul",
                    "head", "body", "html"))
#: A comment or a tag: what begins with < and isn't this is text.
OPENING = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9]*)|[!?/])")
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*HIDDEN, "title")}
HREF = re.compile(r"(?<![\w-])href\s*=\s*", re.I)
UNQUOTED = re.compile(r"[^\s>]+")
LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
CHARSET = re.compile(r"\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def record_id(*parts: str) -> str:
    """The same identifier for the same parts, in any run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A whole record. Fields without a value are left out."""
    head = CRLF.join([VERSION, *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"])
    return (head + CRLF + CRLF).encode() + block + (CRLF + CRLF).encode()


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each gzip member of a file."""
    at = 0
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof and at < len(data):
            piece = data[at:at + (1 << 16)]
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        raw = b"".join(parts)
        if not raw:
            continue
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        yield fields, rest[:int(fields["content-length"])]


def _uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def response(page_id: int | None, url: str | None, page: str | None, date: str) -> bytes:
    payload, uri = (page or "").encode(), _uri(url)
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}"
    block, key = http.encode() + payload, None if page_id is None else str(page_id)
    return record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key or "", uri or "", digest(payload))),
                   ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest(payload)),
                   ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
                   ("Source-Row-ID", key)], block)


class Page:
    """A page's text, title, language, charset and links, from one pass that
    only goes forward: its time grows with the page, whatever is left open.

    Comments, hidden elements and tags go; a hidden element, comment or tag
    that is never closed hides the rest of the page. A title that is never
    closed is none. Nothing counts that a comment or hidden element holds.
    """

    def __init__(self, page: str):
        self.title = self.language = self.charset = None
        self.links: list[str] = []
        self.kept: list[str] = []
        at, titled = 0, False
        while m := OPENING.search(page, at):
            self.kept.append(page[at:m.start()])
            if m[1]:
                end = page.find("-->", m.end())
                at = end + 3 if end >= 0 else len(page)
                continue
            end = page.find(">", m.end())
            at = end + 1 if end >= 0 else len(page)
            name = (m[3] or "").lower()
            if name in BLOCKS:
                self.kept.append("\n")
            if m[2] or not name or end < 0:
                continue
            if name in HIDDEN:
                close = CLOSING[name].search(page, at)
                at = close.end() if close else len(page)
            elif name == "a":
                self._link(page, m.end(), at)
            elif name == "title" and not titled:
                titled, close = True, CLOSING[name].search(page, at)
                self.title = " ".join(html.unescape(page[at:close.start()]).split()) if close else None
            elif name == "html" and self.language is None and (found := LANG.search(page, m.end(), at)):
                self.language = found[1]
            elif name == "meta" and self.charset is None and (found := CHARSET.search(page, m.end(), at)):
                self.charset = found[1]
        self.kept.append(page[at:])

    def _link(self, page: str, start: int, end: int) -> None:
        if not (found := HREF.search(page, start, end)):
            return
        at, mark = found.end(), page[found.end():found.end() + 1]
        close = page.find(mark, at + 1) if mark and mark in "\"'" else -1
        if close >= 0:
            self.links.append(page[at + 1:close])
        elif value := UNQUOTED.match(page, at, end):
            self.links.append(value[0])

    def text(self) -> str:
        """Block elements end lines, entities are resolved, blanks are joined, empty lines go."""
        lines = (" ".join(line.split()) for line in html.unescape("".join(self.kept)).split("\n"))
        return "\n".join(line for line in lines if line)


def plain_text(page: str) -> str:
    return Page(page).text()


def derivatives(fields: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """The metadata and the conversion record of a response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    if digest(block) != fields.get("warc-block-digest", digest(block)):
        raise ValueError(f"{fields['warc-record-id']}: wrong block digest")
    page, source = payload.decode("utf-8", "replace"), fields["warc-record-id"]
    refers = [("WARC-Date", fields["warc-date"]), ("WARC-Target-URI", fields.get("warc-target-uri")),
              ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", fields.get("warc-target-uri")),
              ("WARC-Refers-To-Date", fields["warc-date"]), ("Source-Row-ID", fields.get("source-row-id"))]
    read = Page(page)
    text = read.text().encode()
    text_id = record_id("conversion", source)
    conversion = record([("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), *refers,
                         ("WARC-Block-Digest", digest(text)), ("Content-Type", "text/plain; charset=utf-8")], text)
    found = [("title", read.title), ("language", read.language), ("charset", read.charset),
             ("sourcePayloadDigest", fields.get("warc-payload-digest") or digest(payload))]
    found += [(f"http-{name.strip().lower()}", value.strip())
              for name, mark, value in (line.partition(":") for line in head.decode("utf-8", "replace").split(CRLF)[1:]) if mark]
    found += [("outlink", _uri(html.unescape(link).strip())) for link in read.links]
    body = "".join(f"{k}: {v}{CRLF}" for k, v in found if v is not None).encode()
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", source)), *refers,
                       ("WARC-Concurrent-To", text_id), ("WARC-Block-Digest", digest(body)),
                       ("Content-Type", "application/warc-fields")], body)
    return metadata, conversion


def _files(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Records to rows of at most a file's bytes each, without the last zero byte."""
    def row(members: list[bytes]) -> pa.RecordBatch:
        data = b"".join(members)
        if data[-1]:
            data += gzip.compress(b"", mtime=0)  # a record of 16 MB or more came last
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["content"])

    members, size = [], 0
    for r in records:
        members.append(gzip.compress(r, 4, mtime=0))
        size += len(members[-1])
        if size >= FILE_BYTES:
            yield row(members)
            members, size = [], 0
    if members:
        yield row(members)


def _write(rows: DataFrame, run, out: str) -> None:
    (rows.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value")).write
     .option("lineSep", LAST_BYTE).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(out))


def _contents(batches) -> Iterator[bytes]:
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            if data:
                yield data


def write_responses(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", page: str = "html",
                    date: str = "2024-01-01T00:00:00Z") -> None:
    """Write pages as response records."""
    def run(batches):
        def each():
            for batch in batches:
                for i in range(len(batch)):
                    yield response(*(batch.column(c)[i].as_py() for c in range(3)), date)
        yield from _files(each())

    _write(pages.select(F.col(key).cast("bigint"), url, page), run, out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def build_derivatives(spark: SparkSession, source: str, out: str) -> None:
    """Read response records from ``source`` and write their derivatives to ``out``."""
    def run(batches):
        yield from _files(r for data in _contents(batches) for fields, block in parse_records(data)
                          if fields.get("warc-type") == "response" for r in derivatives(fields, block))

    _write(read_files(spark, source), run, out)


FIELDS = (("record_id", "warc-record-id"), ("type", "warc-type"), ("target_uri", "warc-target-uri"),
          ("refers_to", "warc-refers-to"), ("concurrent_to", "warc-concurrent-to"), ("block_digest", "warc-block-digest"),
          ("payload_digest", "warc-payload-digest"), ("row_id", "source-row-id"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row a record: identifiers, links, digests, ``digest_ok`` and the block."""
    def run(batches):
        for data in _contents(batches):
            rows = [([fields.get(f) for _, f in FIELDS], digest(block) == fields.get("warc-block-digest"), block)
                    for fields, block in parse_records(data)]
            for at in range(0, len(rows), 500):
                part = rows[at:at + 500]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([r[0][i] for r in part], pa.string()) for i in range(len(FIELDS))],
                     pa.array([r[1] for r in part], pa.bool_()), pa.array([r[2] for r in part], pa.binary())],
                    names=[*[n for n, _ in FIELDS], "digest_ok", "block"])

    return read_files(spark, path).mapInArrow(run, ", ".join(f"{n} string" for n, _ in FIELDS) + ", digest_ok boolean, block binary")
