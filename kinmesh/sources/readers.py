"""Readers of the five source formats: CSV, JSON lines, Excel, nested JSON, and their dispatch.  Schemas are declared, columns are
checked before any action, and a blank record id fails the read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh import config
from kinmesh.sources.xlsx import read_workbooks
from kinmesh.storage import keep


class SourceError(ValueError):
    pass


def get(path: str) -> Column:
    """A dotted path; absent is null."""
    return F.col(path if "." not in path else ".".join(f"`{p}`" for p in path.split(".")))


def columns_of(source: str) -> list[str]:
    m = config.SOURCES[source]
    return [m["record_id"], *(f for f in m["fields"] if f != m["record_id"])]


def check_columns(df: DataFrame, source: str) -> DataFrame:
    """df, if it has all flat columns that the source maps."""
    if missing := [c for c in columns_of(source) if "." not in c and c not in df.columns]:
        raise SourceError(f"{source}: mapped columns are missing: {missing}")
    return df


def _with_record(df: DataFrame, source: str) -> DataFrame:
    """source, record_ordinal (from 1, in file order) and source_record_id; a blank id raises.  The ordinal is laid down here, at
    ingestion; nothing later infers it.  Rows are numbered inside each split of a file as it is read, and splits, in order of file and
    offset, are shifted by the counts of those before them."""
    key = get(config.SOURCES[source]["record_id"]).cast("string")
    blank = F.coalesce(F.trim(key), F.lit("")) == ""
    columns = df.columns
    try:
        place = [c.alias(n) for c, n in ((df["_metadata.file_path"], "__file"), (df["_metadata.file_block_start"], "__start"))]
        df.select(*place)
    except AnalysisException:  # a source of one partition has no such column
        place = [F.lit("").alias("__file"), F.lit(0).cast("long").alias("__start")]
    rows = keep(df.select(*(F.col(f"`{c}`") for c in columns), *place, F.monotonically_increasing_id().alias("__row")), "records")
    splits = rows.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    # a row a split, of a file's 128 MB: few beside the records
    before = F.sum("__n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    at = rows.join(splits.select("__file", "__start", (before - F.col("__first") + 1).alias("__shift")), ["__file", "__start"])
    return at.select(
        *(F.col(f"`{c}`") for c in columns), F.when(blank, F.raise_error(F.lit(f"{source}: blank record id"))).otherwise(key).alias("source_record_id"), (F.col("__row") + F.col("__shift")).alias("record_ordinal"), F.lit(source).alias("source")
    )


def read_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """With header; a byte order mark is dropped, quoted fields may hold line breaks and doubled quotes."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)
    return _with_record(check_columns(df, source), source)


def read_jsonl(spark: SparkSession, path: str, source: str) -> DataFrame:
    df = spark.read.option("mode", "FAILFAST").json(path)
    return _with_record(check_columns(df, source), source)


def read_nested_json(spark: SparkSession, path: str, source: str) -> DataFrame:
    """An array of objects; every one must have its payload object."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    payload = config.SOURCES[source]["record_id"].split(".")[0]
    if payload not in df.columns:
        raise SourceError(f"{source}: no {payload}")
    return _with_record(df.withColumn(payload, F.when(F.col(payload).isNull(), F.raise_error(F.lit(f"{source}: no {payload}"))).otherwise(F.col(payload))), source)


def read_excel(spark: SparkSession, path: str, source: str) -> DataFrame:
    m = config.SOURCES[source]
    df = read_workbooks(spark, path, m["sheet"], m["marker"], columns_of(source))
    return _with_record(check_columns(df, source), source)


READERS = {"csv": read_csv, "jsonl": read_jsonl, "excel": read_excel, "nested_json": read_nested_json}


def read_source(spark: SparkSession, folder: str, source: str) -> DataFrame:
    m = config.SOURCES[source]
    if m["format"] not in READERS:
        raise SourceError(f"{source}: unknown format {m['format']}")
    return READERS[m["format"]](spark, f"{folder}/{m['path']}", source)


def flat(df: DataFrame, source: str) -> DataFrame:
    """Keys and mapped fields as flat string columns named by their paths (missing ones null)."""
    names = columns_of(source)

    def field(path: str) -> Column:
        kind = df.schema
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return F.lit(None).cast("string")
            kind = kind[part].dataType
        return get(path).cast("string")

    return df.select("source", "record_ordinal", "source_record_id", *(field(n).alias(n) for n in names))
