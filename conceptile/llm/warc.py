"""WARC records, and a derivative builder that turns responses into linked metadata and plain-text conversion records.

A record is a row of RECORD: its type, id, what it refers to, target, date, content type, further headers and the block's bytes. A
header that a record has several times is one entry with a line for each.
``derivatives`` makes two records of each response: a ``metadata`` record (application/warc-fields) with the source's HTTP status
and headers, its digests and what was found in it (title, language, links), and a ``conversion`` record (text/plain) with the
text. Both carry WARC-Refers-To with the id, target and date of the response; their ids follow from that id, so that a lost
executor's work gives the same records again. Everything is narrow: one pass, no shuffle.

``serialised`` writes records as WARC/1.1 (a gzip member each, as archives do), ``parsed`` and ``read_warc`` read them back.

Defined cases: a null payload is an empty one; a null url leaves out the target headers; a response that isn't HTML or text has
a metadata record only, and so has one whose transfer or content encoding can't be undone (``not-converted`` says why); encodings are
undone for the text, and digests are of the payload as sent and as decoded; a block that is no HTTP message is taken as HTML; records that aren't responses are passed over;
repeated rows give repeated records; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BINARY, LONG, STRING, batches_of, column, schema, table

RECORD = schema(record_type=STRING, record_id=STRING, refers_to=STRING, target_uri=STRING, date=STRING, content_type=STRING, headers=T.MapType(STRING, STRING), block=BINARY)
SPACE = uuid.UUID("6f1ab0d2-5c5e-5f0e-9d0c-6b1f6d6a8b11")
DATE = "1970-01-01T00:00:00Z"
_KINDS = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.binary()]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b([^<>]*)>|<(head)(?=[\s/>])[^<>]*>", re.S | re.I)
_IN_HEAD = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^<>]*>|</head\s*>|<(?!/|!|(?:base|basefont|bgsound|link|meta|head)\b)[a-zA-Z]", re.S | re.I)
_END = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template", "svg", "title")}
_BREAK = re.compile(r"<(?:br|/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|aside|main|blockquote|pre|dd|dt|dl|form|title|body|html))\b[^<>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_TITLE = re.compile(r"<title\b[^<>]*>", re.I)
_HEAD_END = re.compile(rb"\r\n\r\n|\n\n")
_CHUNK = re.compile(rb"([0-9a-fA-F]{1,15})[ \t]*(?:;[^\n]*)?\r?\n")
_META = re.compile(rb"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
#: fixed values: byte-order marks
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<(?:a|area)\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def spaced(text: str) -> str:
    return " ".join(html.unescape(_TAG.sub("", text)).split())


def after(kind: str, page: str, at: int, never: set[str]) -> int:
    """Where the element ends whose content begins here. One that is never closed is its tag only; scripts and styles are text
    that is not shown, and end with the page. ``never`` holds the kinds that have no end from here on."""
    end = None if kind in never else _END[kind].search(page, at)
    if end:
        return end.end()
    never.add(kind)
    return len(page) if kind in ("script", "style") else at


def after_head(page: str, at: int, never: set[str]) -> int:
    """Where the head ends whose content begins here: after </head>, or before the first tag that cannot stand in one."""
    while m := _IN_HEAD.search(page, at):
        if m[1]:
            at = after(m[1].lower(), page, m.end(), never)
        elif m[0].startswith("<!--"):
            at = m.end()
        else:
            return m.end() if m[0].startswith("</") else m.start()
    never.add("head")
    return at


def shown(page: str) -> str:
    """The page without its head, comments and hidden elements; of an svg that closes itself only the tag goes."""
    out, at, never = [], 0, set()
    while m := _HIDDEN.search(page, at):
        out.append(page[at : m.start()])
        at = m.end()
        if m[3] and "head" not in never:
            at = after_head(page, at, never)
        elif m[1] and not (m[1].lower() == "svg" and m[2].rstrip().endswith("/")):
            at = after(m[1].lower(), page, at, never)
    return " ".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """Text of a page: lines for its blocks, without what is not shown."""
    lines = _BREAK.sub("\n", shown(page)).split("\n")
    return "\n".join(x for x in map(spaced, lines) if x)


def http_message(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers in order (names lower-cased; a name may come several times, a folded value is one) and payload as sent."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    end = _HEAD_END.search(block)
    head, payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    first, *rest = head.decode("utf-8", "replace").splitlines()
    status = first.split(" ")[1:2]
    headers: list[tuple[str, str]] = []
    for line in rest:
        if line[:1] in " \t" and headers:
            headers[-1] = headers[-1][0], f"{headers[-1][1]} {line.strip()}"
        else:
            name, _, value = line.partition(":")
            headers.append((name.strip().lower(), value.strip()))
    return int(status[0]) if status and status[0].isdigit() else None, headers, payload


def unchunked(data: bytes) -> bytes:
    """The body without its chunks' sizes; one that doesn't begin with a size was put together before it was stored."""
    out, at = [], 0
    while m := _CHUNK.match(data, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        at = m.end() + size
        if at > len(data):
            raise ValueError("a chunk is cut off")
        out.append(data[m.end() : at])
        at += 2 if data.startswith(b"\r\n", at) else 1 if data.startswith(b"\n", at) else 0
    if out:
        raise ValueError("a chunk has no size")
    return data


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The payload without its transfer and content encodings, an error where that can't be done. A body that doesn't look encoded, as it was
    decoded before it was stored, is taken as it is."""
    named = lambda name: [x.strip().lower() for k, v in headers if k == name for x in v.split(",") if x.strip()]
    for coding in [*reversed(named("transfer-encoding")), *reversed(named("content-encoding"))]:
        if coding == "chunked":
            payload = unchunked(payload)
        elif coding in ("gzip", "x-gzip"):
            payload = gzip.decompress(payload) if payload.startswith(b"\x1f\x8b") else payload
        elif coding == "deflate":
            try:
                payload = zlib.decompress(payload)
            except zlib.error:
                payload = zlib.decompress(payload, -zlib.MAX_WBITS)
        elif coding not in ("identity", "none"):
            raise ValueError(f"unknown encoding {coding}")
    return payload


def charset_of(data: bytes, rest: str, is_html: bool) -> str:
    """By a byte-order mark, else the header's parameter, else for HTML what a meta tag in the first kilobyte says, else UTF-8."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name
    said = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", rest, re.I)
    if not said and is_html and (m := _META.search(data[:1024])):
        return m[1].decode("ascii")
    return said[1] if said else "utf-8"


def title_of(page: str) -> str | None:
    """What the first title tag that is closed holds; the close is looked for once."""
    start = _TITLE.search(page)
    end = _END["title"].search(page, start.end()) if start else None
    return page[start.end() : end.start()] if end else None


def derive(source: dict) -> list[dict]:
    """The records made of one response."""
    status, headers, payload = http_message(source["block"] or b"")
    kind, _, rest = next((v for k, v in headers if k == "content-type"), "text/html").partition(";")
    is_html, is_text = kind.strip().lower() in ("text/html", "application/xhtml+xml"), kind.strip().lower().startswith("text/")
    try:
        body, why = decoded(payload, headers), None
    except (ValueError, EOFError, OSError, zlib.error) as e:
        body, why = b"", " ".join(str(e).split())
    try:
        text = body.decode(charset_of(body, rest, is_html), "replace").removeprefix("\ufeff")
    except LookupError:  # a charset that nobody knows
        text = body.decode("utf-8", "replace")
    refers = {"WARC-Refers-To": source["record_id"], "WARC-Source-Payload-Digest": digest(payload), "WARC-Source-Block-Digest": digest(source["block"] or b"")}
    if source["target_uri"] is not None:
        refers["WARC-Refers-To-Target-URI"] = source["target_uri"]
    if source["date"] is not None:
        refers["WARC-Refers-To-Date"] = source["date"]
    one_line = lambda v: " ".join(str(v).split())
    fields = [("via-type", "response"), *([("http-status", status)] if status is not None else []), *[(f"http-{k}", v) for k, v in sorted(headers, key=lambda h: h[0])], ("payload-digest", digest(payload)), ("payload-bytes", len(payload))]
    if why is not None:
        fields.append(("not-converted", why))
    elif body != payload:
        fields += [("decoded-digest", digest(body)), ("decoded-bytes", len(body))]
    if is_html and why is None:
        title, lang = title_of(text), _LANG.search(text)
        fields += [("title", spaced(title))] if title is not None else []
        fields += [("lang", lang[1])] if lang else []
        fields += [("outlink", html.unescape(a or b or c)) for a, b, c in _LINK.findall(text)]
    out = [("metadata", "application/warc-fields", "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode("utf-8", "replace"))]
    if (is_html or is_text) and why is None:
        out.append(("conversion", "text/plain; charset=utf-8", (plain_text(text) if is_html else text).encode("utf-8", "replace")))
    return [
        {"record_type": t, "record_id": record_id(source["record_id"] or "", t), "refers_to": source["record_id"], "target_uri": source["target_uri"], "date": source["date"], "content_type": c, "headers": refers | {"WARC-Block-Digest": digest(b)}, "block": b}
        for t, c, b in out
    ]


def _columns(rows: list[dict]) -> list[pa.Array]:
    return [pa.array([list(r[f.name].items()) if f.name == "headers" else r[f.name] for r in rows], k) for f, k in zip(RECORD, _KINDS, strict=True)]


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id and RECORD: a response record for each page (page_id, url, html), as a crawler would have written it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            rows = []
            for i, url, page in zip(column(batch, "page_id"), column(batch, "url"), column(batch, "html"), strict=True):
                payload = (page or "").encode("utf-8", "surrogatepass")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                rows.append({"record_type": "response", "record_id": record_id(str(i), url or "", digest(payload)), "refers_to": None, "target_uri": url, "date": date, "content_type": "application/http; msgtype=response", "headers": {"WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block)}, "block": block})
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows)], ["page_id", *RECORD.names])

    return pages.select("page_id", "url", "html").mapInArrow(run, T.StructType([T.StructField("page_id", LONG), *RECORD]))


def derivatives(records: DataFrame, keep: str = "page_id") -> DataFrame:
    """``keep`` (a column that says where a record is from) and RECORD: the records derived from the responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            got = [(k, x) for k, *v in zip(*(column(batch, n) for n in (keep, "record_id", "target_uri", "date", "block")), strict=True) for x in derive(dict(zip(("record_id", "target_uri", "date", "block"), v, strict=True)))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], batch.column(0).type), *_columns([x for _, x in got])], [keep, *RECORD.names])

    source = records.where("record_type = 'response'").select(keep, "record_id", "target_uri", "date", "block")
    return source.mapInArrow(run, T.StructType([records.schema[keep], *RECORD]))


def to_bytes(r: dict) -> bytes:
    """One WARC/1.1 record."""
    block = r["block"] or b""
    head = {"WARC-Type": r["record_type"], "WARC-Record-ID": r["record_id"], "WARC-Target-URI": r["target_uri"], "WARC-Date": r["date"], "Content-Type": r["content_type"], **dict(r["headers"] or {}), "Content-Length": str(len(block))}
    if r["refers_to"] is not None:
        head["WARC-Refers-To"] = r["refers_to"]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {x}\r\n" for k, v in head.items() if v is not None for x in v.split("\n")), "\r\n"]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def serialised(records: DataFrame) -> DataFrame:
    """record_id and warc: each record as a gzip member; members one after another are an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            data = [gzip.compress(to_bytes(r), mtime=0) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(data, pa.binary())], ["record_id", "warc"])

    return records.select(*RECORD.names).mapInArrow(run, schema(record_id=STRING, warc=BINARY))


def records_in(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an archive, one after another; a record that is cut off ends it."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the empty lines between records
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
            k = k.strip().lower()
            head[k] = f"{head[k]}\n{v.strip()}" if k in head else v.strip()
        size = int(head.pop("content-length", "0"))
        block = stream.read(size)
        if len(block) < size:
            return
        known = {f: head.pop(f"warc-{f}".replace("_", "-") if f != "record_type" else "warc-type", None) for f in ("record_type", "record_id", "refers_to", "target_uri", "date")}
        yield known | {"content_type": head.pop("content-type", None), "headers": head, "block": block}


def parsed(data: bytes) -> Iterator[dict]:
    raw = io.BytesIO(data)
    try:
        yield from records_in(gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw)
    except (EOFError, zlib.error):
        return  # a member that is cut off ends the archive


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """source (the file) and RECORD, of archives by Spark's own reader; a file is one task's, and its records stream through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1):
            rows: list[dict] = []
            for name, data in zip(column(batch, "path"), column(batch, "content"), strict=True):
                for r in parsed(data):
                    rows.append(r)
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *_columns(rows)], ["source", *RECORD.names])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *_columns(rows)], ["source", *RECORD.names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, T.StructType([T.StructField("source", STRING), *RECORD]))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records of all pages, with their digests and their blocks as text."""
    made = derivatives(responses(table(spark, sf_dir, "pages")))
    header = lambda h: F.element_at("headers", F.lit(h))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", F.length("block").cast("long").alias("content_length"), header("WARC-Block-Digest").alias("block_digest"), header("WARC-Source-Payload-Digest").alias("source_payload_digest"), F.decode("block", "UTF-8").alias("block"))
