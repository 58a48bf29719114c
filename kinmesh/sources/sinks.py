"""Sinks: Parquet inside, gzip CSV for exports, JSON manifests with content hashes that don't depend on row order or file bytes."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIES = 5


def content_hash(df: DataFrame) -> str:
    """Rows and an order-free hash of their values."""
    cols = sorted(df.columns)
    r = df.select(F.xxhash64(F.to_json(F.struct(*cols))).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{r.n}-{r.x & (1 << 64) - 1:016x}-{int(r.s) & (1 << 64) - 1:016x}"


def export_csv(df: DataFrame, path: str, order: list[str], single: bool = False) -> None:
    """Sorted gzip CSV; arrays as ;-joined text.  Parts are ranges of the order: read in the order of their names they are the whole.  single: in
    one part, for small summaries, which one task then writes."""
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    out = df.orderBy(*order).select(*flat)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Atomic on any file system Spark can write: a file beside it, then a rename.  Tried again if another writer holds it."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    to, beside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    fs = to.getFileSystem(conf)
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    for again in range(TRIES):
        fs.delete(to, False)
        if fs.rename(beside, to):
            return
        time.sleep(0.1 * 2**again)
    fs.delete(beside, False)
    raise OSError(f"{path} could not be replaced")


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    write_text(spark, path, json.dumps(content, indent=2, sort_keys=True, default=str))


def remove_stale(spark: SparkSession, *paths: str) -> list[str]:
    """Remove artifacts of an earlier run that this one did not make; those that were there."""
    conf, gone = spark._jsc.hadoopConfiguration(), []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
            gone.append(path)
    return gone


def markdown_table(rows: list[dict], columns: list[str] | None = None) -> str:
    """A Markdown table of small results; cells' bars and line breaks are escaped."""
    names = columns or (list(rows[0]) if rows else [])
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *(line([cell(r[n]) for n in names]) for r in rows)])


def report(title: str, sections: dict[str, DataFrame | str], most: int = 50) -> str:
    """A Markdown report: a heading a section, its text or the first rows of its small table."""
    out = [f"# {title}"]
    for name, body in sections.items():
        text = body if isinstance(body, str) else markdown_table([r.asDict() for r in body.limit(most).collect()], body.columns)
        out.append(f"## {name}\n\n{text}")
    return "\n\n".join(out) + "\n"
