"""Profiling: frequencies of profiling keys, the frequency registry and pair-explosion figures.  Pairs are counted in closed form, never built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.config import RULE2_THRESHOLD
from kinmesh.functions import text

PRESENT = "profiling_key IS NOT NULL AND canonical_concept <> 'source_record_id'"


def value_counts(obs: DataFrame) -> DataFrame:
    """How often each raw value and key occurs in a source's field."""
    return obs.where(PRESENT).groupBy("source", "raw_field", "canonical_concept", "raw_value", "profiling_key").agg(F.count(F.lit(1)).alias("n"))


def record_values(obs: DataFrame) -> DataFrame:
    """Distinct (record, concept, key); the first field in order gives the raw value that is shown."""
    return obs.where(PRESENT).groupBy("rid", "source", "canonical_concept", "profiling_key").agg(F.min_by("raw_value", "raw_field").alias("raw_value"))


def global_frequency(obs: DataFrame) -> DataFrame:
    """Of each concept and key: records over all sources, number of sources, records by source, least raw value."""
    by = record_values(obs).groupBy("canonical_concept", "profiling_key", "source").agg(F.count(F.lit(1)).alias("n"), F.min("raw_value").alias("raw_value"))
    return by.groupBy("canonical_concept", "profiling_key").agg(
        F.sum("n").alias("global_frequency"),
        F.count(F.lit(1)).alias("n_sources"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("frequency_by_source"),
        F.min("raw_value").alias("representative"),
    )


def column_profile(obs: DataFrame) -> DataFrame:
    """Of each source, field and concept: totals, distinct keys, and how many keys occur 1, 2-5, 6-20, 21-40 and over 40 times."""
    keys = obs.groupBy("source", "raw_field", "canonical_concept", "profiling_key").agg(F.count(F.lit(1)).alias("n"))
    have = F.col("profiling_key").isNotNull()
    within = lambda lo, hi: F.count_if(have & F.col("n").between(lo, hi))
    out = keys.groupBy("source", "raw_field", "canonical_concept").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(~have, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(have).alias("n_distinct"),
        F.coalesce(F.max(F.when(have, F.col("n"))), F.lit(0)).alias("max_frequency"),
        within(1, 1).alias("f_1"),
        within(2, 5).alias("f_2_5"),
        within(6, 20).alias("f_6_20"),
        within(21, 40).alias("f_21_40"),
        within(41, 1 << 60).alias("f_over_40"),
    )
    present = F.col("total") - F.col("missing")
    return out.withColumns({"duplicates": present - F.col("n_distinct"), "uniqueness": F.round(F.when(present > 0, F.col("n_distinct") / present), 6)})


def registry(frequency: DataFrame, threshold: int = RULE2_THRESHOLD) -> DataFrame:
    """Values on more than threshold records, with hash, mask and the pairs they would make."""
    concept, key, n = F.col("canonical_concept"), F.col("profiling_key"), F.col("global_frequency")
    return frequency.where(n > threshold).select("canonical_concept", "profiling_key", "global_frequency", "n_sources", "frequency_by_source", text.value_hash(concept, key).alias("value_hash"), text.mask(concept, key).alias("masked"), text.potential_pairs(n).alias("potential_pairs"))


def public_registry(internal: DataFrame) -> DataFrame:
    """What may be shown: no raw keys."""
    return internal.drop("profiling_key", "representative")


def pair_diagnostics(obs: DataFrame, threshold: int = RULE2_THRESHOLD) -> DataFrame:
    """Pair incidences before, removed by and left after the threshold, and the records that hold a removed value."""
    freq = global_frequency(obs).select("canonical_concept", "profiling_key", "global_frequency", text.potential_pairs(F.col("global_frequency")).alias("pairs"))
    high = F.col("global_frequency") > threshold
    pairs = freq.agg(F.sum("pairs").alias("pairs_before"), F.coalesce(F.sum(F.when(high, F.col("pairs"))), F.lit(0)).alias("pairs_removed"), F.count_if(high).alias("n_high"))
    records = record_values(obs).join(freq.where(high), ["canonical_concept", "profiling_key"], "left_semi").agg(F.count_distinct("rid").alias("records_affected"))
    return pairs.select("*", (F.col("pairs_before") - F.col("pairs_removed")).alias("pairs_left")).join(records)


def concept_summary(obs: DataFrame, threshold: int = RULE2_THRESHOLD) -> DataFrame:
    return global_frequency(obs).groupBy("canonical_concept").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("global_frequency").alias("incidences"), F.max("global_frequency").alias("max_frequency"), F.count_if(F.col("global_frequency") > threshold).alias("n_high"))


def identifier_frequency(obs: DataFrame) -> DataFrame:
    """Each field's keys with their counts in the field, in the source and overall."""
    column = obs.where(PRESENT).groupBy("source", "raw_field", "canonical_concept", "profiling_key").agg(F.count(F.lit(1)).alias("field_frequency"))
    by_source = record_values(obs).groupBy("source", "canonical_concept", "profiling_key").agg(F.count(F.lit(1)).alias("source_frequency"))
    total = by_source.groupBy("canonical_concept", "profiling_key").agg(F.sum("source_frequency").alias("global_frequency"), F.count(F.lit(1)).alias("n_sources"))
    return column.join(by_source, ["source", "canonical_concept", "profiling_key"]).join(total, ["canonical_concept", "profiling_key"])


def quality_summary(obs: DataFrame) -> DataFrame:
    """One row: the field with the largest share missing and the most frequent value (ties by name)."""
    cols = column_profile(obs)
    share = F.col("missing") / F.col("total")
    worst = cols.orderBy(share.desc(), "source", "raw_field").limit(1).select(F.concat_ws(".", "source", "raw_field").alias("worst_field"), F.round(share, 6).alias("worst_missing"))
    top = global_frequency(obs).orderBy(F.desc("global_frequency"), "canonical_concept", "profiling_key").limit(1).select("canonical_concept", text.value_hash(F.col("canonical_concept"), F.col("profiling_key")).alias("top_hash"), "global_frequency")
    return worst.join(top)


def availability(fields: dict[str, dict[str, str]], concepts: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(source, concept, available or unavailable), in mapping order."""
    return [(s, c, "available" if c in m.values() else "unavailable") for s, m in fields.items() for c in concepts]
