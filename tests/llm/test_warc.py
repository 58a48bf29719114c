import gzip
import re

from kinmesh.llm import warc

PAGE = b'<html><head><title> A &amp; B </title></head><body><p>One &lt; two</p><a href="/x?a=1&amp;b=2">go</a><script>no()</script></body></html>'


def test_links_and_digests():
    response = warc.response_record(7, "http://a.example/x", PAGE)
    meta, conv = warc.derivatives(response)
    (fields, block), *_ = warc.records(response)
    own = dict(fields)
    for row in (meta, conv):
        ((got, content),) = warc.records(row["record"])
        got = dict(got)
        assert row["refers_to"] == got["WARC-Refers-To"] == own["WARC-Record-ID"]
        assert got["WARC-Target-URI"] == got["WARC-Refers-To-Target-URI"] == "http://a.example/x"
        assert got["WARC-Date"] == own["WARC-Date"] and got["WARC-Block-Digest"] == warc.digest(content) == row["block_digest"]
        assert int(got["Content-Length"]) == len(content) == row["content_length"]
        assert row["digest_state"] == "payload=ok,block=ok" and row["source_payload_digest"] == own["WARC-Payload-Digest"]
    assert meta["record_id"] != conv["record_id"]
    assert conv["block"] == "One < two\ngo" or conv["block"] == "One < two go"
    about = dict(x.split(": ", 1) for x in meta["block"].split("\r\n") if x)
    assert about["title"] == "A & B" and about["outlink"] == "/x?a=1&b=2" and about["http-status"] == "200"
    assert about["source-header-content-type"] == "text/html; charset=utf-8" and about["charset"] == "utf-8"


def test_codings_and_files():
    body = gzip.compress("<p>Grüße</p>".encode("latin-1"))
    chunks = b"%x\r\n" % 10 + body[:10] + b"\r\n%x;ext\r\n" % (len(body) - 10) + body[10:] + b"\r\n0\r\n\r\n"
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html;\r\n charset=ISO-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks
    record = warc.write_record([("warc-type", "response"), ("WARC-RECORD-ID", "<urn:x:1>"), ("WARC-Payload-Digest", "sha1:AAAA"), ("WARC-Warcinfo-ID", "<urn:x:0>")], block)
    info = warc.write_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x:0>")], b"software: x\r\n")
    for data in (info + record, gzip.compress(info) + gzip.compress(record)):
        meta, conv = warc.derivatives(data)
        assert conv["block"] == "Grüße" and conv["status"] == 404 and conv["digest_state"] == "payload=wrong,block=none"
        assert b"WARC-Warcinfo-ID: <urn:x:0>" in meta["record"] and meta["source_payload_digest"] == "sha1:AAAA"


def test_errors():
    assert list(warc.derivatives(b"")) == [] and list(warc.derivatives(None)) == []
    assert [r["error"] for r in warc.derivatives(b"nonsense")] == ["no record header"]
    short = warc.response_record(1, "u", PAGE)[:-20]
    assert next(warc.derivatives(short))["error"].startswith("Content-Length")
    no_id = warc.write_record([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\n\r\n")
    good = warc.response_record(1, "u", PAGE)
    assert [r["record_type"] for r in warc.derivatives(no_id + good)] == [None, "metadata", "conversion"]


def test_pages(spark):
    rows = [(1, "http://a/", "<p>x</p>", "r"), (1, "http://a/", "<p>x</p>", "r"), (2, None, None, "r"), (None, "u v", "", "r"), (3, "http://b/", "<p>" + "long " * 50000, "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    got = warc.page_derivatives(df).collect()
    assert len(got) == 2 * len(rows) and all(r.error is None and r.digest_state == "payload=ok,block=ok" for r in got)
    text = {(r.page_id, r.target_uri): r.block for r in got if r.record_type == "conversion"}
    assert text == {(1, "http://a/"): "x", (2, None): "", (None, "uv"): "", (3, "http://b/"): ("long " * 50000).strip()}
    assert all(re.fullmatch("[0-9a-f]{64}", r.record_sha256) for r in got)
    assert warc.page_derivatives(df.where("false")).collect() == []


def test_a_bad_record_loses_no_other():
    a, b, c = (warc.response_record(k, "u", PAGE) for k in (1, 2, 3))
    ids = [dict(next(warc.records(x))[0])["WARC-Record-ID"] for x in (a, b, c)]
    size = re.search(rb"Content-Length: (\d+)\r\n\r\nHTTP", b)[1]
    zipped = bytearray(gzip.compress(b))
    zipped[len(zipped) // 2] ^= 255
    bad = [b.replace(b"WARC/1.1", b"WORC/1.1"), *(b.replace(b"Content-Length: " + size + b"\r\n\r\nHTTP", x + b"\r\n\r\nHTTP") for x in (b"Content-Length: x", b"Content-Length: 9999999", b"Content-Length: %d" % (int(size) + 50), b"X: 1"))]
    for data in [*(a + x + c for x in bad), gzip.compress(a) + bytes(zipped) + gzip.compress(c)]:
        rows = list(warc.derivatives(data))
        assert [r["record_type"] for r in rows] == ["metadata", "conversion", None, "metadata", "conversion"] and rows[2]["error"]
        assert [rows[0]["refers_to"], rows[3]["refers_to"]] == [ids[0], ids[2]] and rows[2]["refers_to"] in (None, ids[1])


def response(headers, body=PAGE, more=()):
    return warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>"), *more], b"HTTP/1.1 200 OK\r\n" + headers + b"\r\n\r\n" + body)


def test_hostile_headers():
    good = warc.response_record(1, "u", PAGE)
    for name in (b"undefined", b"idna", b"punycode", b"hex", b"rot13", b"base64", b"utf-16-nope", b"mbcs", b"unicode_escape"):
        rows = list(warc.derivatives(response(b"Content-Type: text/html; charset=" + name) + good))
        assert [r["record_type"] for r in rows] == ["metadata", "conversion"] * 2 and "One < two" in rows[1]["block"], name
    odd = response(b"Content-Type: text/html").replace(b"Content-Length: ", "Content-Length: \u0663".encode(), 1)
    assert [r["record_type"] for r in warc.derivatives(odd + good)] == [None, "metadata", "conversion"]
    for bad in (b"Content-Encoding: gzip", b"Content-Encoding: deflate"):
        rows = list(warc.derivatives(response(bad, b"\x1f\x8b not so \x00") + good))
        assert rows[-2]["record_type"] == "metadata" and (rows[0]["error"] or rows[0]["record_type"])


def test_repeated_headers_stay():
    meta, _ = warc.derivatives(response(b"Content-Type: text/html\r\nSet-Cookie: a=1\r\nVia: x\r\nset-cookie: b=2"))
    assert [(h["name"], h["value"]) for h in meta["source_headers"]] == [("content-type", "text/html"), ("set-cookie", "a=1"), ("via", "x"), ("set-cookie", "b=2")]
    assert meta["block"].count("source-header-set-cookie: ") == 2


def test_linear_reading():
    import time

    began = time.time()
    data = warc.response_record(1, "u", b"<p>x</p>") * 20_000
    assert sum(r["record_type"] == "conversion" for r in warc.derivatives(data)) == 20_000
    assert len(list(warc.derivatives(b"WARC/1.0\r\nX: y\r\n" * 50_000))) == 50_000 and time.time() - began < 60


def test_against_another_reading(spark):
    """Every derivative of hand-made pages, by plain means: its digests, links, lengths and identifiers."""
    import base64
    import hashlib

    pages = [(i, f"http://h/{i}", f"<title>T{i}</title><p>para {i} &amp; more</p><p>second</p>" + f"<a href=/l{i}>x</a>" * (i % 3)) for i in range(40)]
    got = warc.page_derivatives(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    html = {k: h.encode() for k, _, h in pages}
    assert len(got) == 80 and len({r.record_id for r in got}) == 80
    for r in got:
        assert r.source_payload_digest == sha(html[r.page_id]) and r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode())
        n = r.page_id
        if r.record_type == "conversion":
            assert r.block == f"para {n} & more\nsecond" + "\n" * (n % 3 > 0) + "x" * (n % 3)
        else:
            assert f"title: T{n}\r\n" in r.block and r.block.count(f"outlink: /l{n}\r\n") == n % 3 and f"payload-length: {len(html[n])}\r\n" in r.block
    by = {}
    for r in got:
        by.setdefault(r.page_id, set()).add(r.refers_to)
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == 40
