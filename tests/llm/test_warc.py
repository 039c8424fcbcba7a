"""Derivatives of web archive records: linkage, digests, text, and the round trip of files."""

import base64
import gzip
import hashlib
import json
import time
import zlib

from loadlens.llm import warc

SF_DIR = "/root/testdata/sf0.001"


def heads(row):
    return {h["name"]: h["value"] for h in row["headers"]}


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_linkage(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    sources = {heads(r)["WARC-Record-ID"]: r for r in warc.responses(pages).collect()}
    assert len(sources) == pages.count()
    derived = warc.derivatives(warc.responses(pages)).collect()
    assert len(derived) == 2 * len(sources)
    assert len({heads(r)["WARC-Record-ID"] for r in derived}) == len(derived)
    for row in derived:
        own = heads(row)
        source = sources[own["WARC-Refers-To"]]
        was = heads(source)
        assert row["page_id"] == source["page_id"]
        assert own["WARC-Target-URI"] == was["WARC-Target-URI"]
        assert own["WARC-Date"] == was["WARC-Date"]
        assert own["WARC-Block-Digest"] == sha(row["block"])
        assert int(own["Content-Length"]) == len(row["block"])
        if own["WARC-Type"] == "metadata":
            meta = json.loads(row["block"])
            assert dict(meta["warc"]) == was
            body = bytes(source["block"]).partition(b"\r\n\r\n")[2]
            assert meta["http"]["body_digest"] == was["WARC-Payload-Digest"] == sha(body)
            assert meta["html"]["title"]
        else:
            text = row["block"].decode()
            assert text and "<p>" not in text and "track(" not in text and "&amp;" not in text


def test_text():
    page = ("<html><head><title>T &amp; U</title><style>p{}</style></head><body>"
            "<!-- gone --><p>One <b>two</b>&nbsp; three<br>four</p><script>var x='</p>';</script>"
            "<ul><li>a<li>b</ul> 1 < 2 <p>last <!-- open")
    assert warc.plain_text(page) == "One two three\nfour\na\nb\n1 < 2\nlast"
    assert warc.plain_text("") == "" and warc.plain_text("<script>never closed") == ""


def test_files(spark, tmp_path):
    rows = [(1, "http://a/", "x\r\n\r\nWARC/1.1\r\n\r\n\r\n"), (2, None, None), (3, "u", ""),
            (3, "u", ""), (None, "http://b\r\nX: y", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    records = warc.responses(pages)
    both = records.unionByName(warc.derivatives(records)).select("headers", "block")
    for kind in ("gzip", "none"):
        path = str(tmp_path / kind)
        warc.write_warc(both, path, kind)
        back = warc.read_warc(spark, path)
        assert sorted(map(str, back.collect())) == sorted(map(str, both.collect()))


def test_odd_records(spark):
    rows = [([("WARC-Type", "response")], b"no header", "a"), ([("warc-type", "RESPONSE")], None, "b"),
            ([("WARC-Type", "request")], b"GET / HTTP/1.1\r\n\r\n", "c"), ([], b"", "d"),
            (None, None, "e"),
            ([("WARC-Type", "response"), ("WARC-Record-ID", "<x>")],
             b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>\xe9", "f"),
            ([("WARC-Type", "response")],
             b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=none\r\n\r\n\xff", "g")]
    df = spark.createDataFrame(rows, f"{warc.RECORD.split(', block')[0]}, block binary, type string")
    found = {}
    for row in warc.derivatives(df).collect():
        found.setdefault(row["type"], []).append((heads(row)["WARC-Type"], bytes(row["block"])))
    assert set(found) == {"a", "b", "f", "g"}
    assert found["a"][1] == ("conversion", b"no header")
    assert found["b"][1] == ("conversion", b"")
    assert found["f"][1] == ("conversion", "é".encode())
    assert warc.derivatives(df.limit(0)).collect() == []


def conversion(head, body):
    made = {h[0]["value"]: data for h, data in warc._derived(
        [{"name": "WARC-Type", "value": "response"}], b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body)}
    return json.loads(made["metadata"]), made.get("conversion")


def test_head_without_an_end():
    page = "<html><head><title>T</title><meta x=1><body><p>All of the text</p></body></html>"
    assert warc.plain_text(page) == "All of the text"
    assert warc.plain_text("<head><title>T</title>text<p>more") == "text\nmore"


def test_coded_bodies():
    page = "<title>T</title><p>Grüße</p>".encode()
    chunks = b"".join(b"%x;a=b\r\n%s\r\n" % (len(page[i:i + 7]), page[i:i + 7])
                      for i in range(0, len(page), 7)) + b"0\r\n\r\n"
    zipped = gzip.compress(page)
    both = b"%x\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped)
    for head, body in ((b"Content-Encoding: gzip", zipped), (b"Transfer-Encoding: chunked", chunks),
                       (b"content-encoding: deflate", zlib.compress(page)),
                       (b"Transfer-Encoding: chunked\r\nContent-Encoding: x-gzip", both)):
        meta, text = conversion(head, body)
        assert text.decode() == "Grüße" and meta["html"]["title"] == "T"
        assert meta["http"]["body_digest"] == sha(body)
    assert conversion(b"Content-Encoding: gzip", b"plain after all")[1] == b"plain after all"
    assert conversion(b"Transfer-Encoding: chunked", b"zz\r\nplain")[1] == b"zz\nplain"
    assert conversion(b"Transfer-Encoding: chunked", b"5\r\nshort")[1] == b"short"


def test_conversions_of_text_only():
    meta, text = conversion(b"Content-Type: image/png", b"\x89PNG<p>")
    assert text is None and meta["html"] == {"title": None, "links": []}
    assert conversion(b"Content-Type: application/xhtml+xml; charset=utf-8", b"<p>x")[1] == b"x"


def test_long_hostile_pages():
    """Tags, comments and quotes without an end are gone through once."""
    for part in ("<a ", "<script ", "<p ", "<title ", "<!-- ", "<title>", '<a href="', "<img src='", "<"):
        started = time.perf_counter()
        conversion(b"Content-Type: text/html", (part * 60_000).encode())
        assert time.perf_counter() - started < 5, part


def test_clashing_columns_pass(spark):
    df = spark.createDataFrame(
        [([("WARC-Type", "response")], b"<p>x", "a", 1)],
        f"{warc.RECORD.split(', block')[0]}, block binary, kind string, `data.x` int")
    assert [(r.kind, r["data.x"]) for r in warc.derivatives(df).collect()] == [("a", 1)] * 2
