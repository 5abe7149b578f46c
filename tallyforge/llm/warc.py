"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

A record is its WARC bytes: version line, named fields, an empty line, the block. ``derive`` reads each response and makes
* a metadata record (``application/warc-fields``): the HTTP status, the source's HTTP headers and its own WARC fields under
  prefixes, title, links;
* a conversion record (``text/plain``): the text of the page, whose body is taken out of its transfer and content coding
  (chunked, gzip, deflate) and decoded by the charset that the header, a byte order mark or the page itself names;
both with WARC-Refers-To naming the response, WARC-Refers-To-Target-URI, -Date and the payload digest they come from, their
own block digest, and WARC-Concurrent-To between the two. Identifiers are version-5 style UUIDs of SHA-1 digests, so that a
lost task makes the same records again. Mapping Arrow batches needs no shuffle. Files are read record by record by Spark's
text source, cut where a record begins; plain files are split over tasks, and a task holds a batch of records, never a file.

Defined cases: a body that its coding does not fit is taken as it is, an unknown charset is UTF-8; a page without html has an empty payload and empty text; a null url is the empty target; records of other
types, and bytes that are no record, have no derivatives; texts are whole; repeated rows give repeated records.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table

#: Pages carry no time of capture; the default stands for all.
CAPTURED = "1970-01-01T00:00:00Z"
DERIVED = "derived_kind string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, n_links int, n_chars long, record binary"
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: Up to its end or to the first text or element that cannot stand in it.
_HEAD = re.compile(r"<head\b[^>]*>(?:\s+|<title\b[^>]*>.*?</title\s*>|</?(?:title|meta|link|base)\b[^>]*>)*(?:</head\s*>)?", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|aside|blockquote|pre|hr|form|main)\b[^>]*>?", re.I)
_TAG = re.compile(r"<[^>]*(?:>|\Z)")
_CHARSET = re.compile(rb"<meta\b[^>]{0,400}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
#: What follows a record and begins the next.
_BETWEEN = b"\r\nWARC/1."
_LINK = re.compile(r"<(?:a|area)\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title|\Z)", re.S | re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: bytes) -> str:
    raw = bytearray(hashlib.sha1(b"\0".join(parts)).digest()[:16])
    raw[6], raw[8] = raw[6] & 0x0F | 0x50, raw[8] & 0x3F | 0x80
    return f"<urn:uuid:{uuid.UUID(bytes=bytes(raw))}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Fields (names in lower case) and block of a record, None if it is none."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    size = fields.get("content-length", "")
    return fields, rest[: int(size)] if size.isdigit() else rest


def dechunked(data: bytes) -> bytes:
    """The body of a chunked transfer; data that is none stays."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return data
        if not n:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n
        if data[at : at + 2] == b"\r\n":
            at += 2


def body_of(headers: dict[str, str], payload: bytes) -> bytes:
    """The payload without its transfer and content coding."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        payload = dechunked(payload)
    coding = headers.get("content-encoding", "").lower().strip()
    try:
        if coding in ("gzip", "x-gzip"):
            return gzip.decompress(payload)
        if coding == "deflate":
            return zlib.decompress(payload, -15 if payload[:1] and payload[0] & 15 != 8 else 15)
    except (OSError, EOFError, zlib.error):
        pass
    return payload


def text_of(headers: dict[str, str], body: bytes) -> str:
    """The body as text."""
    named = re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", headers.get("content-type", ""), re.I)
    inside = _CHARSET.search(body[:4096])
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    for name in (named and named[1], inside and inside[1].decode("ascii", "replace")):
        try:
            if name and codecs.lookup(name)._is_text_encoding:
                return body.decode(name, "replace")
        except LookupError:
            continue
    return body.decode("utf-8", "replace")


def response(key: str, url: str, page: str, captured: str = CAPTURED) -> bytes:
    payload = page.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id(b"response", key.encode(), url.encode(), payload)), ("WARC-Date", captured), ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
    ], block)


def plain_text(page: str) -> str:
    """All text of a page, one line for each block."""
    found = entities.unescape(_TAG.sub("", _BREAK.sub("\n", _HEAD.sub(" ", _HIDDEN.sub(" ", page.replace("\n", " ").replace("\r", " "))))))
    return "\n".join(line for x in found.split("\n") if (line := " ".join(x.split())))


def derivatives(data: bytes) -> list[tuple]:
    """Rows of DERIVED for one response record, none for any other record."""
    found = parse(data)
    if not found or found[0].get("warc-type") != "response":
        return []
    fields, block = found
    source, target, date = fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""), fields.get("warc-date", CAPTURED)
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *headers = head.decode("utf-8", "replace").split("\r\n")
    paid = fields.get("warc-payload-digest") or digest(payload)
    told = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in headers)}
    page = text_of(told, body_of(told, payload))
    text, title = plain_text(page), _TITLE.search(page)
    links = [one_line(entities.unescape("".join(x))) for x in _LINK.findall(page)]
    meta = [("http-status", status), *((f"http-header-{k.strip().lower()}", v.strip()) for k, _, v in (h.partition(":") for h in headers))]
    meta += [(f"source-{k}", v) for k, v in fields.items()]
    meta += [("title", one_line(entities.unescape(title[1]))) if title else ("title", ""), *(("outlink", x) for x in links), ("text-digest", digest(text.encode()))]
    blocks = {"metadata": "".join(f"{k}: {v}\r\n" for k, v in meta).encode(), "conversion": text.encode()}
    ids = {kind: record_id(kind.encode(), source.encode(), b) for kind, b in blocks.items()}
    out = []
    for kind, b in blocks.items():
        other = ids["conversion" if kind == "metadata" else "metadata"]
        told = [
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target),
            ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", other), ("WARC-Source-Payload-Digest", paid), ("WARC-Block-Digest", digest(b)),
            ("Content-Type", "application/warc-fields" if kind == "metadata" else "text/plain; charset=utf-8"),
        ]
        out.append((kind, ids[kind], source, target, paid, digest(b), len(links), len(text), record(told, b)))
    return out


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): the response record of each page (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([response(str(i), u or "", h or "") for i, u, h in rows], pa.binary())], names=["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, record binary")


def derive(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, DERIVED): two rows for each response among records (id, record)."""
    names = [x.split()[0] for x in DERIVED.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *d) for i, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for d in derivatives(r or b"")]
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=[id_col, *names])

    source = records.select(id_col, "record")
    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, {DERIVED}")


def whole_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """(file, record) from the pieces (file, bytes) between places that look like the beginning of a record.

    A block may hold such a place itself: pieces are joined until a record has the length that it declares.
    """
    name, held = None, b""

    def short(data: bytes) -> int:
        """How many bytes the block lacks."""
        head, gap, rest = data.partition(b"\r\n\r\n")
        size = re.search(rb"(?im)^content-length[ \t]*:[ \t]*([0-9]+)[ \t]*\r?$", head)
        return int(size[1]) - len(rest) if gap and size else 0

    def done(data: bytes) -> bytes:
        head, gap, rest = data.partition(b"\r\n\r\n")
        return head + gap + rest[: len(rest) + short(data)] + b"\r\n\r\n"

    for file, data in pieces:
        if held and file == name and short(held) > 0:
            held += _BETWEEN + data
            continue
        if held:
            yield name, done(held)
        name, held = file, data if data.startswith(b"WARC/") else _BETWEEN[2:] + data
    if held:
        yield name, done(held)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, record) of all .warc and .warc.gz files below a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, d) for batch in batches for f, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if d.strip())
        for file, found in whole_records(rows):
            yield pa.RecordBatch.from_pydict({"file": [file], "record": [found]})

    reader = spark.read.option("lineSep", _BETWEEN.decode()).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*")
    return reader.text(path).select(F.col("_metadata.file_path"), F.col("value").cast("binary")).mapInArrow(run, "file string, record binary")


def op5(spark, sf_dir: str) -> DataFrame:
    """Per page and derivative, what links it to its source, and the digest of its whole record."""
    found = derive(responses(table(spark, sf_dir, "pages")))
    return found.select("page_id", "derived_kind", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "n_links", "n_chars", F.sha2("record", 256).alias("record_sha256"))
