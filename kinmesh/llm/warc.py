"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record gives two records.  ``metadata`` (application/warc-fields) lists the HTTP status, the source's
HTTP headers as they were, the charset, digests and whether they hold, title and outlinks.  ``conversion``
(text/plain) is the payload's text, a leaf block a line.  Both refer to the response by WARC-Refers-To, repeat its
target URI and date (also as WARC-Refers-To-Target-URI and -Date), name its warcinfo and IP where it does, and
carry digests of their own.  Record ids are UUIDs of version 5, of the response's id and the record type: the
same input always gives the same records.

Responses are read from WARC bytes: plain or gzip members, header lines in any case and folded, HTTP payloads
chunked and gzip- or deflate-coded.  A record that can't be read gives one row with its error and no record, and
reading goes on at the next header; so does a gzip member that can't be inflated, with all that is in it.  A charset that
isn't one is read as UTF-8.  All headers of the response are kept in order, repeated ones too.  Very long payloads are
read whole, in time linear in their length.  A
digest that doesn't hold is reported, not dropped.  Records of other types give no row.

From a table of pages: null url, no target URI; null html, an empty payload.  Repeated rows give repeated
records.  Empty table: empty result.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.html_crf import leaf_blocks

#: The date of records built from a table that has none.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6f0d5b52-6c0e-5d0c-9a3e-2f6b1d7c9e10")
ROW = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, status int, content_type string, source_headers array<struct<name:string,value:string>>, source_payload_digest string, source_block_digest string, digest_state string, block_digest string, content_length long, block string, record binary, error string"


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def holds(claim: str | None, data: bytes) -> bool | None:
    """Whether a labelled digest is that of data; None if there is none or it isn't known."""
    if not claim or ":" not in claim:
        return None
    name, value = claim.split(":", 1)
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    own = hashlib.new(name, data)
    return value.strip().rstrip("=") in (base64.b32encode(own.digest()).decode().rstrip("="), base64.b64encode(own.digest()).decode().rstrip("=")) or value.strip().lower() == own.hexdigest()


def _fields(raw: bytes) -> list[tuple[str, str]]:
    """Name-value lines; a line that begins with white space continues the last."""
    out: list[tuple[str, str]] = []
    for line in re.split(rb"\r?\n", raw):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def _first(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def inflate(data: bytes) -> bytes:
    """All gzip members, or the data as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out) if out else data


def _members(data: bytes) -> Iterator[bytes | WarcError]:
    """The data as they are, or runs of good gzip members, with an error for each bad one between them."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    run = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            run.append(member.decompress(data) + member.flush())
            data = member.unused_data
        except zlib.error as e:
            yield b"".join(run)
            yield WarcError(str(e))
            run, at = [], data.find(b"\x1f\x8b\x08", 1)
            while at >= 0 and not _starts(data[at : at + 4096]):  # these bytes may also lie within the bad member
                at = data.find(b"\x1f\x8b\x08", at + 1)
            data = data[at:] if at >= 0 else b""
    yield b"".join(run)


def _starts(data: bytes) -> bool:
    """Whether a gzip member begins here that begins with a record."""
    try:
        return zlib.decompressobj(31).decompress(data, 64).lstrip(b"\r\n").startswith(b"WARC/")
    except zlib.error:
        return False


BLANK = re.compile(rb"\r?\n\r?\n")
HEADER, NEXT = re.compile(rb"WARC/\d+\.\d+\r?\n(.*?)\r?\n\r?\n", re.S), re.compile(rb"(?<=\n)WARC/\d+\.\d+\r?\n")


def _read(file: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes | WarcError]]:
    """Header fields and block of each record; a bad record or gzip member has its error for a block, and reading goes on at the next header."""
    for data in _members(file):
        if isinstance(data, WarcError):
            yield [], data
            continue
        at, end = 0, len(data.rstrip(b"\r\n"))
        blank = BLANK.search(data)
        while at < end:
            while data[at : at + 1] in (b"\r", b"\n"):
                at += 1
            # a header that runs into the next record's has no end of its own; each byte is looked at a few times at most
            if blank is not None and blank.start() < at:
                blank = BLANK.search(data, at)
            m = HEADER.match(data, at, blank.end()) if blank else None
            follows = NEXT.search(data, at + 1, blank.end()) if blank else None
            if not m or follows:
                follows = follows or NEXT.search(data, blank.end() if blank else at + 1)
                yield [], WarcError("no record header")
                at = follows.start() if follows else end
                continue
            fields = _fields(m[1])
            size = _first(fields, "Content-Length")
            stop = m.end() + int(size) if size and re.fullmatch("[0-9]{1,18}", size) else None
            if stop is not None and stop <= len(data) and not re.compile(rb"[\r\n]*(?:WARC/|\Z)").match(data, stop) and NEXT.search(data, m.end(), stop):
                stop = None  # ends within a later record
            if stop is None or stop > len(data):
                follows = NEXT.search(data, m.end())
                yield fields, WarcError("Content-Length is missing or beyond the data")
                at = follows.start() if follows else end
                continue
            at = stop
            yield fields, data[m.end() : at]


def records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Header fields and block of each record of a file; raises at one that can't be read."""
    for fields, block in _read(data):
        if isinstance(block, WarcError):
            raise block
        yield fields, block


def write_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _unchunk(data: bytes) -> bytes:
    out, at = [], 0
    while m := re.compile(rb"\s*([0-9a-fA-F]+)[^\r\n]*\r?\n").match(data, at):
        size = int(m[1], 16)
        if not size:
            break
        out.append(data[m.end() : m.end() + size])
        at = m.end() + size
    return b"".join(out)


def http_response(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes, bytes]:
    """Status, headers, the payload as sent, and its content decoded."""
    m = re.match(rb"HTTP/\S+\s+(\d{3})[^\r\n]*\r?\n(.*?)(?:\r?\n\r?\n|\Z)", block, re.S)
    if not m:
        return None, [], block, block
    headers, payload = _fields(m[2]), block[m.end() :]
    body = _unchunk(payload) if "chunked" in (_first(headers, "Transfer-Encoding") or "").lower() else payload
    coding = (_first(headers, "Content-Encoding") or "").lower()
    try:
        if "gzip" in coding:
            body = inflate(body)
        elif "deflate" in coding:
            body = zlib.decompress(body) if body[:1] == b"\x78" else zlib.decompress(body, -15)
    except zlib.error as e:
        raise WarcError(f"content coding: {e}") from e
    return int(m[1]), headers, payload, body


def charset(headers: list[tuple[str, str]], body: bytes) -> str:
    said = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", _first(headers, "Content-Type") or "", re.I)
    found = said[1] if said else None
    if not found and (m := re.search(rb"<meta[^>]{0,200}charset\s*=\s*[\"']?\s*([\w.:-]+)", body[:4096], re.I)):
        found = m[1].decode()
    return decoder(found or "utf-8")


#: Codecs of the language, which no page is written in.
NOT_CHARSETS = frozenset("punycode idna undefined mbcs oem unicode-escape raw-unicode-escape".split())


def decoder(name: str) -> str:
    """name, in lower case, if it is a text encoding that can decode any bytes; else utf-8."""
    try:
        found = codecs.lookup(name) if "\0" not in name else None
        if found is None or not found._is_text_encoding or found.name in NOT_CHARSETS:
            return "utf-8"
        bytes(range(256)).decode(name, "replace")
        return name.lower()
    except (LookupError, ValueError):  # some names are no encodings, and some encodings only speak up when used
        return "utf-8"


def derive(fields: list[tuple[str, str]], block: bytes) -> list[dict]:
    """The metadata and conversion rows of a response record."""
    source = _first(fields, "WARC-Record-ID")
    if not source:
        raise WarcError("no WARC-Record-ID")
    target, date = _first(fields, "WARC-Target-URI"), _first(fields, "WARC-Date")
    status, headers, payload, body = http_response(block)
    claims = {"payload": _first(fields, "WARC-Payload-Digest"), "block": _first(fields, "WARC-Block-Digest")}
    tests = {"payload": holds(claims["payload"], payload), "block": holds(claims["block"], block)}
    if tests["payload"] is False and holds(claims["payload"], body):
        tests["payload"] = True  # of the decoded payload, as some writers do
    state = ",".join(f"{k}={'none' if v is None else 'ok' if v else 'wrong'}" for k, v in tests.items())
    name = charset(headers, body)
    kind = (_first(headers, "Content-Type") or "").split(";")[0].strip().lower()
    markup = kind in ("text/html", "application/xhtml+xml") or (not kind and re.match(rb"\s*<", body) is not None)
    text = body.decode(name, "replace") if markup or kind.startswith("text/") else ""
    title = re.search(r"<title[^>]*>(.*?)</title", text, re.S | re.I) if markup else None
    links = [html.unescape(x.strip("\"'")) for x in re.findall(r"""<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", text, re.I)] if markup else []
    plain = "\n".join(b.text for b in leaf_blocks(text)) if markup else text
    about = [
        ("http-status", str(status) if status is not None else None),
        ("content-type", kind or None),
        ("charset", name),
        ("payload-length", str(len(payload))),
        ("source-payload-digest", claims["payload"] or digest(payload)),
        ("source-block-digest", claims["block"] or digest(block)),
        ("digest-state", state),
        ("title", " ".join(html.unescape(title[1]).split()) if title else None),
        *((f"source-header-{k.lower()}", v) for k, v in headers),
        *(("outlink", " ".join(x.split())) for x in links),
    ]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in about if v is not None)), "conversion": ("text/plain; charset=utf-8", plain)}
    kept = [(k, v) for k in ("WARC-Warcinfo-ID", "WARC-IP-Address", "WARC-Identified-Payload-Type") if (v := _first(fields, k))]
    rows = []
    for record_type, (mime, content) in blocks.items():
        raw = content.encode("utf-8", "replace")
        own = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{source} {record_type}')}>"
        head = [("WARC-Type", record_type), ("WARC-Record-ID", own), ("WARC-Refers-To", source)]
        head += [(k, v) for k, v in (("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)) if v]
        head += [*kept, ("WARC-Block-Digest", digest(raw)), ("WARC-Payload-Digest", digest(raw)), ("Content-Type", mime)]
        rows.append(
            dict(record_type=record_type, record_id=own, refers_to=source, target_uri=target, warc_date=date, status=status, content_type=mime, source_headers=[{"name": k.lower(), "value": v} for k, v in headers], source_payload_digest=claims["payload"] or digest(payload), source_block_digest=claims["block"] or digest(block), digest_state=state, block_digest=digest(raw), content_length=len(raw), block=content, record=write_record(head, raw), error=None)
        )
    return rows


NAMES = [x.split()[0] for x in ROW.split(", ")]


def derivatives(data: bytes | None) -> Iterator[dict]:
    """The rows of all response records of a file."""
    for fields, block in _read(data or b""):
        if isinstance(block, WarcError):
            yield dict.fromkeys(NAMES) | {"refers_to": _first(fields, "WARC-Record-ID"), "error": str(block)}
        elif (_first(fields, "WARC-Type") or "").lower() == "response":
            try:
                yield from derive(fields, block)
            except (ValueError, LookupError, ArithmeticError, MemoryError, zlib.error) as e:
                yield dict.fromkeys(NAMES) | {"refers_to": _first(fields, "WARC-Record-ID"), "error": str(e) or type(e).__name__}


def response_record(key: int | None, url: str | None, page: bytes | None, date: str = DATE) -> bytes:
    """A page as a response record.  Its id is a UUID of the key, the url and the payload."""
    payload = page or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    own = uuid.uuid5(NAMESPACE, f"{key} {url} {digest(payload)}")
    target = [("WARC-Target-URI", "".join(url.split()))] if url and url.split() else []
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), *target, ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return write_record(fields, block)


# ---------------------------------------------------------------- columns


def page_responses(pages: DataFrame) -> DataFrame:
    """page_id, warc: each page as a WARC file of one response."""

    def run(batches):
        for batch in batches:
            made = [response_record(*x) for x in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "warc"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("binary")).mapInArrow(run, "page_id long, warc binary")


def build_derivatives(files: DataFrame, key: str, warc: str = "warc") -> DataFrame:
    """key (a long) of each file and ROW's columns for each derivative of its responses."""
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<struct<name:string,value:string>>": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))}
    kinds = [types[x.split()[1]] for x in ROW.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(k, r) for k, data in zip(part.column(0).to_pylist(), part.column(1)) for r in derivatives(data.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), *(pa.array([r[n] for _, r in rows], t) for n, t in zip(NAMES, kinds))], names=["key", *NAMES])

    return files.select(F.col(key).cast("long").alias("key"), F.col(warc).cast("binary").alias("warc")).mapInArrow(run, f"key long, {ROW}").withColumnRenamed("key", key)


def page_derivatives(pages: DataFrame) -> DataFrame:
    """build_derivatives of pages as responses, with the records' lengths and SHA-256 in place of their bytes."""
    out = build_derivatives(page_responses(pages), "page_id")
    return out.select("page_id", *(n for n in NAMES if n not in ("record", "source_headers")), F.to_json("source_headers").alias("source_headers"), F.length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
