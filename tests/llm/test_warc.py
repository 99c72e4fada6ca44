import gzip
import io

import pytest
from conceptile.llm.warc import RECORD, derivatives, derive, digest, op9_warc_derivatives, parsed, plain_text, read_warc, responses, serialised, to_bytes
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string"


def test_whole_table_is_linked(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    sources = {r.page_id: r for r in responses(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    got = op9_warc_derivatives(spark, sf_dir).collect()
    assert len(got) == 2 * len(pages) and len({r.record_id for r in got}) == len(got)
    for r in got:
        source, payload = sources[r.page_id], pages[r.page_id].html.encode()
        assert (r.refers_to, r.target_uri, r.date) == (source.record_id, pages[r.page_id].url, source.date)
        assert r.source_payload_digest == digest(payload) and r.block_digest == digest(r.block.encode()) and r.content_length == len(r.block.encode())
        if r.record_type == "metadata":
            assert f"payload-digest: {digest(payload)}\r\n" in r.block and "http-content-type: text/html" in r.block
        else:
            assert "<p>" not in r.block and "track(0)" not in r.block and r.block


def test_text_of_a_page():
    page = "<!doctype html><html lang=de><head><title>T &amp; t</title><style>p{}</style></head><body><!-- no --><p>One<br>two <b>th</b>ree&nbsp;&lt;4<script>x('</p>')</script><p>five<ul><li>a<li>b</ul></body>"
    assert plain_text(page) == "One\ntwo three <4\nfive\na\nb"
    made = derive({"record_id": "<urn:uuid:1>", "target_uri": "http://x/", "date": "2020-01-01T00:00:00Z", "block": b"HTTP/1.1 404 Not Found\r\nServer: s\r\nContent-Type: text/html\r\n\r\n" + page.encode() + b"<a href='/l?a&amp;b'>"})
    assert made[0]["block"].decode().split("\r\n")[:4] == ["via-type: response", "http-status: 404", "http-content-type: text/html", "http-server: s"]
    assert b"title: T & t\r\nlang: de\r\noutlink: /l?a&b\r\n" in made[0]["block"]
    assert made[1]["headers"]["WARC-Refers-To"] == "<urn:uuid:1>" and made[1]["headers"]["WARC-Refers-To-Target-URI"] == "http://x/"


@pytest.mark.parametrize(("kind", "n"), [("image/png", 1), ("text/plain; charset=latin-1", 2), ("text/html; charset=nobody", 2), ("application/xhtml+xml", 2)])
def test_other_kinds(kind, n):
    made = derive({"record_id": "a", "target_uri": None, "date": None, "block": f"HTTP/1.0 200 OK\r\nContent-Type: {kind}\r\n\r\n".encode() + "é".encode("latin-1")})
    assert len(made) == n and "WARC-Refers-To-Target-URI" not in made[0]["headers"]
    assert "latin" not in kind or made[1]["block"].decode() == "é"


def test_archives_round_trip(spark, sf_dir, tmp_path):
    made = responses(spark.read.parquet(f"{sf_dir}/pages.parquet").limit(20))
    both = made.select(*RECORD.names).unionByName(derivatives(made).select(*RECORD.names))
    (tmp_path / "x.warc.gz").write_bytes(b"".join(r.warc for r in serialised(both).collect()))
    flat = lambda r, lower: {k: ({a.lower(): b for a, b in v.items()} if lower else v) if k == "headers" else bytes(v) if k == "block" else v for k, v in r.asDict().items() if k != "source"}
    want = {r.record_id: flat(r, True) for r in both.collect()}
    for r in want.values():
        r["headers"].pop("warc-refers-to", None)
    back = read_warc(spark, str(tmp_path))
    assert {r.record_id: flat(r, False) for r in back.collect()} == want
    assert derivatives(back, "source").count() == 40


def test_archives_that_are_cut_off_or_plain():
    record = {"record_type": "response", "record_id": "a", "refers_to": None, "target_uri": "u", "date": None, "content_type": None, "headers": {}, "block": b"WARC/1.1\r\n\r\n" * 9}
    data = to_bytes(record)
    assert [r["block"] for r in parsed(data * 3)] == [record["block"]] * 3
    assert len(list(parsed(data + data[:-50]))) == 1 and len(list(parsed(gzip.compress(data) + gzip.compress(data)[:-20]))) >= 1 and list(parsed(b"")) == []
    assert io.BytesIO(data).readline() == b"WARC/1.1\r\n"


def test_defined_cases(spark, table_dir):
    rows = [(1, None, "<p>a"), (2, "http://x/", None), (2, "http://x/", None), (None, "u", ""), (5, "http://y/", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"record_id": F.lit("clash"), "block": F.lit(1)})
    got = op9_warc_derivatives(spark, table_dir(pages=pages)).collect()
    assert len(got) == 10 and {r.block for r in got if r.page_id == 2 and r.record_type == "conversion"} == {""}
    assert all(r.target_uri is None for r in got if r.page_id == 1) and max(r.content_length for r in got) > 499_000
    assert op9_warc_derivatives(spark, table_dir(pages=pages.limit(0))).collect() == []


@pytest.mark.parametrize(("page", "text"), [
    ("<html><head><title>T</title><meta charset=utf-8><body><p>One", "One"),
    ("<head><title>T</title><link rel=x><script>if (a<b) x('<p>')</script><!-- <p> --><p>One<p>two", "One\ntwo"),
    ("<head><title>T <b>x</b></title><style>p{}</style></head><p>One", "One"),
    ("<p>One<svg width=1 /><p>two<svg><text>no</text></svg><p>three", "One\ntwo\nthree"),
    ("<p>One<template><p>two<noscript><p>three", "One\ntwo\nthree"),
    ("<header>Top</header><p>One<script>never closed <p>two", "Top\nOne"),
])
def test_open_heads_and_elements_leave_the_body(page, text):
    assert plain_text(page) == text


def test_whole_table_against_another_parser(spark, sf_dir):
    """Text, title, language and links of every page, by the standard library's parser."""
    from html.parser import HTMLParser

    hidden = {"script", "style", "noscript", "template", "svg", "head"}
    breaks = set("br p div h1 h2 h3 h4 h5 h6 li ul ol tr table article section header footer nav aside main blockquote pre dd dt dl form title body html".split())

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.open, self.title, self.in_title, self.links, self.lang = [], [], [], False, [], None

        def handle_starttag(self, tag, attrs):
            if tag == "title":
                self.in_title = True
            if tag in ("a", "area") and dict(attrs).get("href") is not None:
                self.links.append(" ".join(dict(attrs)["href"].split()))
            if tag == "html" and self.lang is None:
                self.lang = dict(attrs).get("lang")
            if tag in hidden:
                self.open.append(tag)
            elif tag in breaks and not self.open:
                self.out.append("\n")

        def handle_endtag(self, tag):
            if tag == "title":
                self.in_title = False
            if tag in self.open:
                self.open.remove(tag)
                self.out.append(" ")
            elif tag in breaks and not self.open:
                self.out.append("\n")

        def handle_data(self, data):
            if self.in_title:
                self.title.append(data)
            if not self.open:
                self.out.append(data.replace("\n", "\n"))

    got = {}
    for r in op9_warc_derivatives(spark, sf_dir).collect():
        got[r.page_id, r.record_type] = r.block
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for r in pages:
        page = Reader()
        page.feed(r.html or "")
        page.close()
        lines = [" ".join(x.split()) for x in "".join(page.out).split("\n")]
        assert got[r.page_id, "conversion"].split() == "\n".join(x for x in lines if x).split()
        fields = [x.split(": ", 1) for x in got[r.page_id, "metadata"].split("\r\n") if x]
        assert [v for k, v in fields if k == "title"] == ([" ".join("".join(page.title).split())] if page.title else [])
        assert [v for k, v in fields if k == "lang"] == ([page.lang] if page.lang else [])
        assert [v for k, v in fields if k == "outlink"] == page.links
    assert len(got) == 2 * len(pages)


def response(head, body):
    return {"record_id": "a", "target_uri": None, "date": None, "block": b"HTTP/1.1 200 OK\r\n" + b"".join(h.encode() + b"\r\n" for h in head) + b"\r\n" + body}


def chunked(body, size=4):
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x;x=y\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\nTrailer: t\r\n\r\n"


def test_repeated_and_folded_headers_stay():
    made = derive(response(["Set-Cookie: a=1", "Content-Type: text/html", "Set-Cookie: b=2", "X-Long: one", "  two"], b"<p>x"))
    lines = made[0]["block"].decode().split("\r\n")
    assert [x for x in lines if x.startswith("http-")] == ["http-status: 200", "http-content-type: text/html", "http-set-cookie: a=1", "http-set-cookie: b=2", "http-x-long: one two"]
    record = {"record_type": "response", "record_id": "a", "refers_to": None, "target_uri": "u", "date": None, "content_type": None, "headers": {"warc-concurrent-to": "x\ny"}, "block": b""}
    assert to_bytes(record).count(b"warc-concurrent-to: ") == 2 and next(parsed(to_bytes(record)))["headers"] == record["headers"]


@pytest.mark.parametrize("codings", [["chunked"], ["gzip"], ["deflate"], ["raw"], ["gzip", "chunked"], ["deflate", "gzip", "chunked"], []])
def test_encodings_are_undone(codings):
    import zlib

    page = "<title>Hé</title><p>Hello é".encode()
    body = page
    for c in codings:
        raw = zlib.compressobj(wbits=-15)
        body = {"chunked": chunked, "gzip": gzip.compress, "deflate": zlib.compress, "raw": lambda b, z=raw: z.compress(b) + z.flush()}[c](body)
    content = ", ".join("deflate" if c == "raw" else c for c in codings if c != "chunked")
    made = derive(response(["Content-Type: text/html; charset=utf-8", *([f"Content-Encoding: {content}"] if content else []), *(["Transfer-Encoding: chunked"] if "chunked" in codings else [])], body))
    assert made[1]["block"].decode() == "Hello é" or made[1]["block"].decode().endswith("Hello é")
    said = made[0]["block"].decode()
    assert f"payload-digest: {digest(body)}" in said and "title: Hé" in said and (f"decoded-digest: {digest(page)}" in said) == bool(codings)
    assert made[1]["headers"]["WARC-Source-Payload-Digest"] == digest(body)


@pytest.mark.parametrize(("head", "body"), [("Content-Encoding: gzip", gzip.compress(b"<p>word " * 99)[:-20]), ("Content-Encoding: br", b"xx"), ("Transfer-Encoding: chunked", b"5\r\nab"), ("Transfer-Encoding: chunked", b"2\r\nab\r\nzz"), ("Content-Encoding: deflate", b"no")])
def test_what_cannot_be_decoded_has_metadata_alone(head, body):
    made = derive(response(["Content-Type: text/html", head], body))
    assert [r["record_type"] for r in made] == ["metadata"] and b"not-converted: " in made[0]["block"] and b"decoded-digest" not in made[0]["block"]


def test_bodies_that_were_decoded_before_are_taken_as_they_are():
    assert derive(response(["Content-Encoding: gzip", "Transfer-Encoding: chunked"], b"<p>plain"))[1]["block"] == b"plain"


@pytest.mark.parametrize(("kind", "body"), [("text/html", b"<head><meta http-equiv=x content='text/html; charset=ISO-8859-1'></head><p>caf\xe9"), ("text/html", b"<meta charset=\"latin-1\"><p>caf\xe9"), ("text/html", b"\xef\xbb\xbf<meta charset=latin-1><p>caf\xc3\xa9"), ("text/plain", "\ufeffcafé".encode("utf-16")), ("text/html; charset='utf-8'", b"<meta charset=latin-1><p>caf\xc3\xa9"), ("text/plain", b"\xff\xfec\0a\0f\0\xe9\0")])
def test_charsets(kind, body):
    assert derive(response([f"Content-Type: {kind}"], body))[1]["block"].decode().lstrip("\ufeff") == "café"


@pytest.mark.parametrize("bit", ["<title>", "<title>x", "<script>", "<head>", "<svg>", "<!--", "<a href=", "<a ", "<html lang=", "<meta charset="])
def test_a_megabyte_of_open_tags(bit):
    import time

    began = time.process_time()
    derive(response(["Content-Type: text/html"], bit.encode() * (1_000_000 // len(bit))))
    assert time.process_time() - began < 6
