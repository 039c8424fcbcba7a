"""Web archive records: responses, and the metadata and plain text derived from them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Record layout of the WARC format, version 1.1.
VERSION = "WARC/1.1"
RESPONSE_TYPE = "application/http;msgtype=response"
METADATA_TYPE = "application/json"
TEXT_TYPE = "text/plain"
RECORD = "headers array<struct<name: string, value: string>>, block binary"
_END = "\r\n\r\n"

# What stands in a head has no text of its own but for these, so a head without an end hides
# nothing else.  No pattern looks at a tag without an end twice.
_HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template)\b[^>]*+"
    r"(?:>.*?(?:</\1\s*>|\Z)|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]"
    r"|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"</?[a-z!?][^>]*(?:>|\Z)", re.I)
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_LINK = re.compile(r"<(a|img|link|script)\b[^<>]*?\b(?:href|src)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)",
                   re.I)
_BLANK = re.compile(r"[ \t\f\v\r\xa0]+")


def digest(data: bytes) -> str:
    """Labelled digest as archives write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: bytes | None) -> str:
    """The same id for the same parts in every run."""
    state = hashlib.sha1()
    for part in parts:
        state.update(b"-" if part is None else b"%d:" % len(part) + part)
    return f"<urn:uuid:{uuid.UUID(bytes=state.digest()[:16], version=5)}>"


def plain_text(source: str) -> str:
    """Readable text of a page: one line for each block, no markup, entities resolved."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("", source)))
    lines = (_BLANK.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def _header(headers: list[dict], name: str) -> str | None:
    return next((h["value"] for h in headers or () if h["name"].lower() == name.lower()), None)


def _split(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """Status line, header lines and body of an HTTP response; all body if there is no header."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [[p.strip() for p in line.partition(":")[::2]] for line in lines], body


def _field(headers: list[list[str]], name: str) -> str:
    return next((v for n, v in headers if n.lower() == name), "").lower()


def _unchunked(body: bytes) -> bytes:
    """The data of a chunked body; from the first chunk that is none, the rest as it stands."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9a-fA-F]{1,15})\s*(?:;.*)?", body[at:end] if end > 0 else b"")
        if not size:
            return b"".join([*out, body[at:]])
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + n])
        at = end + 2 + n + 2
        if at >= len(body):
            return b"".join(out)


def _inflated(body: bytes, kind: int) -> bytes:
    """Members of compressed data, up to the first byte that is not; as it stands if that is all."""
    out, rest = [], body
    while rest:
        state = zlib.decompressobj(kind)
        try:
            out += [state.decompress(rest), state.flush()]
        except zlib.error:
            break
        rest = state.unused_data
    return b"".join(out) if any(out) else body


def _payload(headers: list[list[str]], body: bytes) -> bytes:
    """The body without its transfer coding and its compression."""
    if "chunked" in _field(headers, "transfer-encoding"):
        body = _unchunked(body)
    coding = _field(headers, "content-encoding")
    if "gzip" in coding:
        return _inflated(body, 31)
    return _inflated(body, 15) if coding == "deflate" else body


def _is_text(headers: list[list[str]]) -> bool:
    """Whether a response without type, or with this one, is text."""
    kind = _field(headers, "content-type").partition(";")[0].strip()
    return not kind or kind.startswith("text/") or kind.endswith(("+xml", "+json")) or kind in (
        "application/xml", "application/json", "application/javascript")


def _charset(headers: list[list[str]]) -> str:
    kind = next((v for n, v in headers if n.lower() == "content-type"), "")
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    try:
        return "".encode(found[1]) and "" or found[1] if found else "utf-8"
    except LookupError:
        return "utf-8"


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages (url, html): WARC headers and the HTTP response as the block.

    A column page_id is passed on.  A null page is an empty body, a null url leaves the target
    out.  Equal rows give equal records, ids included.
    """
    keyed = pages.select(pages["page_id"].cast("long").alias("page_id")
                         if "page_id" in pages.columns else F.lit(None).cast("long")
                         .alias("page_id"), "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers, blocks = [], []
            for key, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (page or "").encode()
                block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                         f"Content-Length: {len(body)}\r\n\r\n").encode() + body
                # A line break in an address would end the header.
                target = None if url is None else re.sub(r"[\r\n]+", "", url)
                name = record_id(str(key).encode(), url and url.encode(), block)
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", name),
                          ("WARC-Date", date), ("WARC-Target-URI", target),
                          ("WARC-Payload-Digest", digest(body)),
                          ("WARC-Block-Digest", digest(block)),
                          ("Content-Type", RESPONSE_TYPE), ("Content-Length", str(len(block)))]
                headers.append([{"name": n, "value": v} for n, v in fields if v is not None])
                blocks.append(block)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(headers, _HEADERS),
                 pa.array(blocks, pa.binary())], ["page_id", "headers", "block"])

    return keyed.mapInArrow(run, f"page_id long, {RECORD}")


_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def _derived(headers: list[dict], block: bytes | None) -> Iterator[tuple[list[dict], bytes]]:
    block = block or b""
    source = _header(headers, "WARC-Record-ID")
    status, fields, body = _split(block)
    is_text = _is_text(fields)
    page = _payload(fields, body).decode(_charset(fields), "replace") if is_text else ""
    title = _TITLE.search(page)
    meta = {
        "warc": [[h["name"], h["value"]] for h in headers or ()],
        "http": {"status": status, "headers": fields, "body_length": len(body),
                 "body_digest": digest(body)},
        "html": {"title": _BLANK.sub(" ", html.unescape(title[1])).strip() if title else None,
                 "links": [[m[1].lower(), html.unescape(m[2].strip("\"'"))]
                           for m in _LINK.finditer(page)]},
    }
    made = [("metadata", METADATA_TYPE, json.dumps(meta, ensure_ascii=False).encode(
        "utf-8", "replace"))]
    if is_text:
        made.append(("conversion", TEXT_TYPE, plain_text(page).encode("utf-8", "replace")))
    for kind, media, data in made:
        known = [("WARC-Type", kind),
                 ("WARC-Record-ID", record_id(kind.encode(), source and source.encode(), block)),
                 ("WARC-Date", _header(headers, "WARC-Date")),
                 ("WARC-Target-URI", _header(headers, "WARC-Target-URI")),
                 ("WARC-Refers-To", source),
                 ("WARC-Block-Digest", digest(data)), ("Content-Type", media),
                 ("Content-Length", str(len(data)))]
        yield [{"name": n, "value": v} for n, v in known if v is not None], data


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record (headers, block).

    Both refer to the response by its id and keep its date and target.  The metadata record
    holds the response's WARC headers (digests included), its status and HTTP headers, and the
    page's title and links; the conversion record holds the plain text, and there is one for text
    types only.  Chunked and compressed bodies are decoded for it; digests are those of the body
    as it was sent.  Records of other types give none.  A block without HTTP header counts as body; a null block is empty; a header that
    the response lacks is left out.  Other columns are passed on, whatever their names.  Very long
    pages are gone through once by each pattern, repeated records give equal derivatives, and an
    empty table has no rows.
    """
    keep = [c for c in records.columns if c not in ("headers", "block")]
    passed = [f"passed{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, headers, blocks = [], [], []
            rows = zip(batch.column("headers").to_pylist(), batch.column("block").to_pylist(),
                       strict=True)
            for i, (own, block) in enumerate(rows):
                if (_header(own, "WARC-Type") or "").lower() == "response":
                    for head, data in _derived(own, block):
                        at.append(i)
                        headers.append(head)
                        blocks.append(data)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(at, pa.int64())) for c in passed),
                 pa.array(headers, _HEADERS), pa.array(blocks, pa.binary())],
                [*passed, "headers", "block"])

    # Python functions take no column whose name has dots.
    fields = [f"{p} {records.schema[c].dataType.simpleString()}"
              for p, c in zip(passed, keep, strict=True)]
    given = [F.col(f"`{c}`").alias(p) for p, c in zip(passed, keep, strict=True)]
    return records.select(*given, "headers", "block").mapInArrow(
        run, ", ".join([*fields, RECORD])).toDF(*keep, "headers", "block")


def header(name: str):
    """Value of a WARC header of a record."""
    found = F.filter("headers", lambda h: F.lower(h["name"]) == name.lower())
    return F.get(found, F.lit(0))["value"]


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records (headers, block) as WARC files, one for each partition.

    Records end with two line breaks, which the text writer puts between rows.
    """
    lines = F.array_join(F.transform("headers", lambda h: F.concat(
        h["name"], F.lit(": "), h["value"])), "\r\n")
    head = F.concat(F.lit(f"{VERSION}\r\n"), lines, F.lit("\r\n\r\n")).cast("binary")
    whole = F.concat(head, F.coalesce("block", F.lit(b""))).cast("string")
    records.select(whole.alias("value")).write.option("lineSep", _END).option(
        "compression", compression).text(path)


def _parsed(data: bytes) -> Iterator[tuple[list[dict], bytes]]:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at:at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        _, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = [dict(zip(("name", "value"), (p.strip() for p in line.partition(":")[::2]),
                            strict=True)) for line in lines]
        size = int(_header(headers, "Content-Length") or 0)
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (headers, block) of WARC files, plain or compressed with gzip.

    Blocks are cut by their stated length, so they may hold anything.  A file is read by one
    task; archives are customarily of a gigabyte or less.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for headers, block in _parsed(data.as_py()):
                    rows.append((headers, block))
                    held += len(block)
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    def batch_of(rows):
        headers, blocks = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(headers, _HEADERS), pa.array(blocks, pa.binary())], ["headers", "block"])

    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    return files.select("content").mapInArrow(run, RECORD)
