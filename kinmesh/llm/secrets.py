"""Secret scan with corpus-wide ownership frequency.

Base spans, leftmost and non-overlapping per kind (offsets in code points, end exclusive):
  assign  a key word, separator and value of 6 or more characters (the whole match is the span)
  access  AKIA and more capitals or digits, 20 or more characters
  hex     24 or more lowercase hex digits
The method: every value that a base span holds, and every other opaque token (20 or more characters of one
credential alphabet with letters and digits mixed at high entropy), is a candidate.  Candidate hashes are
counted over the whole corpus by distinct repositories and owners.  A value seen with WIDE or more owners is a
widely copied example; one that stays below, with a shape that looks live (entropy, no placeholder), is an
owner-specific live-looking credential.  Opaque tokens that are live and not inside a base span are added
as spans of kind ``live``; base spans always stay.

An owner is a document's source; a repository is its source and language.  Null source or language count as
one unknown owner or repository.  Very long texts are scanned whole.  Null text: as empty, no spans.  Empty table: empty result.  Repeated rows
and ids keep their rows (rows are told apart by a row number, not by doc_id).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.shared import keep
from kinmesh.operators.skew import hot_join

# The patterns of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "live")
#: Words that mark an example or placeholder.
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]?|test[_-]?key|x{4,}|(.)\1{5,}|123456|abcdef", re.I)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Distinct owners from which on a value counts as widely copied.
WIDE = 3
#: Bits a character that an opaque token needs; by the alphabet's size, short tokens need less than they could have.
ENTROPY = 3.2
LIVE_ENTROPY = 2.5

SCAN = "doc_id long, owner string, repository string, base array<struct<kind:string,begin:int,stop:int>>, found array<struct<hash:string,kind:string,begin:int,stop:int,live:boolean>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind as listed."""
    out = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end(), m[0]) for m in LONG_HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


#: The maximal runs of HEX with HEX_LEAST or more digits: HEX takes whole runs, so shorter runs can be skipped.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % HEX_LEAST)


def looks_live(value: str) -> bool:
    return entropy(value) >= LIVE_ENTROPY and not PLACEHOLDER.search(value)


def opaque_tokens(text: str) -> list[tuple[int, int, str]]:
    """Tokens of 20 or more characters with letters and digits at high entropy."""
    return [(m.start(), m.end(), m[0]) for m in OPAQUE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and entropy(m[0]) >= ENTROPY]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping ones as one; spans that only touch stay apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str) -> tuple[list[dict], list[dict]]:
    """The base spans and the candidates (base values first) of a text."""
    base = base_spans(text)
    found = {}
    for kind, a, b, value in base:
        found[kind, a, b] = (value, looks_live(value))
    taken = merged([(a, b) for _, a, b, _ in base])
    starts = [a for a, _ in taken]
    for a, b, value in opaque_tokens(text):
        k = bisect_left(starts, b)  # of the spans that begin before the token ends, the last one ends last
        if not k or taken[k - 1][1] <= a:
            found["live", a, b] = (value, looks_live(value))
    digest = lambda v: hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32]
    return (
        [{"kind": k, "begin": a, "stop": b} for k, a, b, _ in base],
        [{"hash": digest(v), "kind": k, "begin": a, "stop": b, "live": live} for (k, a, b), (v, live) in found.items()],
    )


def scan_documents(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row for each document: owner, repository, base spans and hashed candidates; values don't leave the
    worker.  carry: with doc, a struct of all of docs' columns."""

    def run(batches):
        kind = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("stop", pa.int32())])
        more = pa.struct([("hash", pa.string()), ("kind", pa.string()), ("begin", pa.int32()), ("stop", pa.int32()), ("live", pa.bool_())])
        for batch in batches:
            got = [scan(x or "") for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *batch.columns[4:], pa.array([x[0] for x in got], pa.list_(kind)), pa.array([x[1] for x in got], pa.list_(more))],
                names=["doc_id", "owner", "repository", *["doc"] * carry, "base", "found"],
            )

    owner = F.coalesce(F.col("source").cast("string"), F.lit(""))
    repository = F.concat_ws("/", owner, F.coalesce(F.col("lang").cast("string"), F.lit("")))
    whole = [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc")] * carry
    rows = docs.select("doc_id", owner.alias("owner"), repository.alias("repository"), "text", *whole)
    schema = SCAN.replace("base array", f"doc {rows.schema['doc'].dataType.simpleString()}, base array") if carry else SCAN
    return rows.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """Of each candidate hash: n_owners, n_repositories, n_seen.  Sums a (hash, owner, repository) first, on
    the map side too, so a value that a third of all documents hold costs a row for each task and owner."""
    by = found.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by = by.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    return by.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n_seen"))


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["stop"].cast("string"))), ",")


def _order(kind):
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def judged_marks(rows: DataFrame) -> DataFrame:
    """Of each row that holds a candidate: marks (begin, place, stop, kind, hash, live, n_owners, n_repositories)
    by start, then kind as listed; live: looks live and has fewer than WIDE owners."""
    found = keep(rows.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("c")).select("row", "owner", "repository", "c.*"), "candidates")
    mark = F.struct("begin", _order(F.col("kind")).alias("place"), "stop", "kind", "hash", (F.col("live") & (F.col("n_owners") < WIDE)).alias("live"), "n_owners", "n_repositories")
    return hot_join(found, ownership(found), "hash").groupBy("row").agg(F.array_sort(F.collect_list(mark)).alias("marks"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """row (a number), doc_id, base and marks (see judged_marks; null where there are none)."""
    rows = keep(scan_documents(docs).withColumn("row", F.monotonically_increasing_id()), "secrets")
    return rows.join(judged_marks(rows), "row", "left").select("row", "doc_id", "base", "marks")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_example (candidates judged live, or seen with WIDE or more owners)."""
    of = secret_spans(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    marked = lambda test: F.coalesce(F.size(F.filter("marks", test)), F.lit(0)).cast("long")
    shown = F.filter("marks", lambda s: (s["kind"] != "live") | s["live"])
    return of.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(_joined(shown), F.lit("")).alias("spans"),
        marked(lambda s: s["live"]).alias("n_live"),
        marked(lambda s: s["n_owners"] >= WIDE).alias("n_example"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every live span of its text replaced by mark (overlapping spans by one), and n_chars, where
    docs has it, counted anew.  Widely copied examples stay, and so does every other text.  Columns and rows are those of docs."""
    rows = keep(scan_documents(docs, carry=True).withColumn("row", F.monotonically_increasing_id()), "redact")
    spans = F.transform(F.filter("marks", lambda s: s["live"]), lambda s: F.struct(s["begin"].alias("begin"), s["stop"].alias("stop")))
    marks = judged_marks(rows).select("row", spans.alias("spans")).where(F.size("spans") > 0)
    clean = rows.where(F.size("found") == 0).select("doc.*")
    some = rows.where(F.size("found") > 0).select("row", "doc").join(marks, "row", "left")
    same = some.where("spans IS NULL").select("doc.*")
    kind = some.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            new = [redacted(t, [(s["begin"], s["stop"]) for s in x], mark) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["doc", "text"])

    hidden = some.where("spans IS NOT NULL").select("doc", "doc.text", "spans").mapInArrow(run, f"doc {kind}, text string")
    value = {"text": F.col("text"), "n_chars": F.length("text")}
    changed = hidden.select(*((value[c] if c in value else F.col("doc")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
    return clean.unionByName(same).unionByName(changed)


def redacted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for a, b in merged(spans):
        out += (text[at:a], mark)
        at = b
    return "".join(out) + text[at:]
