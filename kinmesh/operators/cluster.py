"""Clusters of records: components of auto-merge edges under a hard size cap, whole components accepted or quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh import config
from kinmesh.operators.graph import components


def edge_faults(scored: DataFrame) -> DataFrame:
    """Edges whose decision doesn't fit their score; empty if all is well."""
    s, d = F.col("mct_score"), F.col("decision")
    fits = ((d == "auto_merge") & (s >= config.AUTO_MERGE)) | ((d == "human_review") & (s >= config.HUMAN_REVIEW) & (s < config.AUTO_MERGE)) | ((d == "leave_separate") & (s < config.HUMAN_REVIEW))
    return scored.where(~F.coalesce(fits, F.lit(False)))


def stable_id(prefix: str, parts: Column) -> Column:
    """prefix and 20 hex digits over sorted structs (source, record_ordinal, source_record_id): SHA-256 of the parts, each led by its length in four bytes."""

    def one(x: Column) -> Column:
        raw = F.encode(x.cast("string"), "utf-8")
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 8, "0")), raw)

    whole = F.aggregate(F.array_sort(parts), F.unhex(F.lit("")), lambda acc, p: F.concat(acc, one(p["source"]), one(p["record_ordinal"]), one(p["source_record_id"])))
    return F.concat(F.lit(prefix), F.substring(F.sha2(whole, 256), 1, 20))


def assign(records: DataFrame, scored: DataFrame) -> DataFrame:
    """records (rid, source, record_ordinal, source_record_id) with component (smallest rid), size, ids and status.  A component of more than
    COMPONENT_MAX records is quarantined whole: no part of it is merged.  The members' list that an id is made from is gathered
    for accepted components only, so it is never longer than the cap."""
    edges = scored.where("decision = 'auto_merge'").select(F.col("l").alias("a"), F.col("r").alias("b"))
    comp = components(records.select(F.col("rid").alias("node")), edges)
    rows = records.join(comp, records.rid == comp.node).drop("node")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("component_size"))
    rows = rows.join(sizes, "component")
    small = F.col("component_size") <= config.COMPONENT_MAX
    ids = rows.where(small).groupBy("component").agg(stable_id("CMP-", F.collect_list(F.struct("source", "record_ordinal", "source_record_id"))).alias("final_cluster_id"))
    status = F.when(F.col("component_size") == 1, "accepted_singleton").when(small, "accepted_merged").otherwise("quarantined_oversized").alias("cluster_status")
    return rows.join(ids, "component", "left").select("rid", "source", "record_ordinal", "source_record_id", "component", "component_size", F.coalesce("final_cluster_id", F.lit("")).alias("final_cluster_id"), status)


def size_distribution(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("component_size", "cluster_status").agg(F.count_distinct("component").alias("components"), F.count(F.lit(1)).alias("records"))


def identity_count(assigned: DataFrame) -> DataFrame:
    """One row: components, quarantined components and records, and identities when quarantined records count each for itself."""
    by = assigned.groupBy("component", "cluster_status").agg(F.count(F.lit(1)).alias("n"))
    bad = F.col("cluster_status") == "quarantined_oversized"
    out = by.agg(F.count(F.lit(1)).alias("components"), F.count_if(bad).alias("quarantined_components"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("quarantined_records"))
    return out.withColumn("identities", F.col("components") - F.col("quarantined_components") + F.col("quarantined_records"))


def largest_component(assigned: DataFrame) -> DataFrame:
    """The largest component, the one with the smallest root on a tie."""
    return assigned.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)


def quarantine_profile(assigned: DataFrame, scored: DataFrame) -> DataFrame:
    """Of each quarantined component: records, sources, auto-merge edges and their scores."""
    bad = assigned.where("cluster_status = 'quarantined_oversized'")
    people = bad.groupBy("component").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source").alias("sources"))
    edges = scored.where("decision = 'auto_merge'").join(bad.select(F.col("rid").alias("l"), "component"), "l")
    by = edges.groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.min("mct_score").alias("min_score"), F.max("mct_score").alias("max_score"), F.round(F.avg("mct_score"), 4).alias("mean_score"))
    return people.join(by, "component")


