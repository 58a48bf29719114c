"""Excel workbooks, read with the standard library from bytes that Spark fetches: shared and inline strings, a preferred sheet, and a header
row found by a marker in the first 25 rows.  Rows without a value and columns without a name are dropped."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HEADER_ROWS = 25
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class XlsxError(ValueError):
    pass


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str | None) -> list[list[str | None]]:
    """The rows of the named sheet, or of the first one."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(_REL)] for s in book.iterfind("m:sheets/m:sheet", _NS)}
        target = sheets.get(sheet) or next(iter(sheets.values()))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        tree = ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/")))
    out = []
    for row in tree.iterfind("m:sheetData/m:row", _NS):
        cells: list[str | None] = []
        for c in row.iterfind("m:c", _NS):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            v = c.find("m:v", _NS)
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif v is not None and v.text is not None:
                cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
        out.append(cells)
    return out


def table(rows: list[list[str | None]], marker: str) -> tuple[list[str], list[list[str | None]]]:
    """Names and rows below the header."""
    for n, row in enumerate(rows[:HEADER_ROWS]):
        if marker in [str(x).strip() for x in row if x is not None]:
            keep = [(i, str(x).strip()) for i, x in enumerate(row) if x is not None and str(x).strip()]
            body = [[r[i] if i < len(r) else None for i, _ in keep] for r in rows[n + 1 :]]
            return [x for _, x in keep], [r for r in body if any(v not in (None, "") for v in r)]
    raise XlsxError(f"no header with {marker} in the first {HEADER_ROWS} rows")


def read_workbooks(spark: SparkSession, path: str, sheet: str | None, marker: str, columns: list[str]) -> DataFrame:
    """The named columns, as text, of the workbooks at path: on any file system that Spark reads.  A workbook is one compressed file (its format ends
    at 1,048,576 rows), so one task reads it."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                names, rows = table(sheet_rows(data.as_py(), sheet), marker)
                if lost := [c for c in columns if c not in names]:
                    raise XlsxError(f"columns are missing: {lost}")
                at = [names.index(c) for c in columns]
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([None if r[k] is None else str(r[k]) for r in part], pa.string()) for k in at], names=columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))
