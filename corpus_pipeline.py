"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; it is written as Parquet and
read again before the next.  All but the last return the columns of documents; the last returns the places of
the pieces in the packed sequences.

Null text: no words, so quality_rules drops it; a later stage given one keeps it (near-dedup: as a text without words; secrets, packing:
as empty) but for mix_sources, which takes nothing of a document without words.  Null doc_id: is never trusted, stays only if no other of
its group has an id, and rows of a null source are a source of their own.  Repeated rows: near-dedup leaves one, every other stage treats each by
itself.  Ties: the smallest doc_id, then the place of the row.  Empty table: empty result.  Extra columns of any name ride along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinmesh.llm import mixing, near_dup, packing, quality, secrets
from kinmesh.llm.shared import drop, keep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score below the threshold go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id."""
    return near_dup.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific live-looking credentials are replaced; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Hashes, a trained ratio, connected components and a token vocabulary aren't to be had in SQL; run() is tested against the stages by brute force, each on what the last one kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        drop(before)  # nothing reads it any more: what came of it is written
    packed = STAGES[-1][1](spark, docs, sf_dir)
    drop(docs)  # packing reads pieces that it has written itself
    return packed
