"""Tables in the folder all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a write are let go when it ends: what it wrote is read from then on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.RLock()
_WRITING: dict[int, tuple[int, str | None]] = {}
_OWN: dict[str, str] = {}


class StorageError(RuntimeError):
    pass


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by the cluster in spark.checkpoint.dir.  Only a session on one machine (local[n]) may leave it
    unset: it gets a folder of its own that goes when the process ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise StorageError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    with _LOCK:
        if "local" not in _OWN:
            _OWN["local"] = tempfile.mkdtemp(prefix="kinmesh-")
            atexit.register(shutil.rmtree, _OWN["local"], True)
        return _OWN["local"]


def _begin(spark: SparkSession) -> None:
    with _LOCK:
        n, before = _WRITING.get(id(spark), (0, spark.conf.get(CLEANUP, None)))
        if not n:
            spark.conf.set(CLEANUP, "true")
        _WRITING[id(spark)] = (n + 1, before)


def _end(spark: SparkSession) -> None:
    with _LOCK:
        n, before = _WRITING.pop(id(spark))
        if n > 1:
            _WRITING[id(spark)] = (n - 1, before)
        elif before is not None:
            spark.conf.set(CLEANUP, before)
        else:
            spark.conf.unset(CLEANUP)


def kept_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/kept/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost
    executors, and fixes what a later read sees (row ids, partition numbers).  drop() removes it."""
    spark = df.sparkSession
    path = kept_path(spark, label)
    _begin(spark)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        _end(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Remove kept tables that nothing reads any more.  Frames that keep() didn't make are passed over."""
    for df in tables:
        path = df.__dict__.get("_kept") if df is not None else None
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_all(spark: SparkSession) -> None:
    """Remove every kept table of the shared folder: at the end of a job, when its results are written."""
    remove(spark, f"{shared_folder(spark).rstrip('/')}/kept")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
