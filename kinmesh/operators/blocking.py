"""Candidate generation: frequency rule, block keys, capped blocks and pairs by an equi self-join.

A value on more than 40 records takes no part, and no block of more than 40 records does.  Both caps are applied by a group limit that
works before the shuffle, so a value or key that all records share costs 41 rows a task, and pairs are built inside blocks of 40 at most."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh import config
from kinmesh.functions import text
from kinmesh.operators.observe import valid
from kinmesh.operators.skew import gathered_within, within

UNIT = "\x1f"
#: Every rule, sorted.
RULES = sorted([*(f"exact_{c}" for c in config.EXACT_CONCEPTS), "email_skeleton", "email_sha256_bridge", "phone_suffix_9", "numeric_account_reference", "name_city", "name_date_of_birth", "name_postcode"])


def concept_values(obs: DataFrame) -> DataFrame:
    """Distinct (rid, source, concept, value) of valid observations; record ids are no evidence."""
    return valid(obs).where("canonical_concept <> 'source_record_id'").select("rid", "source", F.col("canonical_concept").alias("concept"), F.col("normalized_value").alias("value")).distinct()


def frequency(values: DataFrame) -> DataFrame:
    """Records that hold each value."""
    return values.groupBy("concept", "value").agg(F.count(F.lit(1)).alias("global_frequency"))


def rule2_registry(values: DataFrame, threshold: int = config.RULE2_THRESHOLD) -> DataFrame:
    """Values above the threshold with their counts by source.  Counted by source first, so both levels come from one exchange of sums."""
    by = values.groupBy("concept", "value", "source").agg(F.count(F.lit(1)).alias("n"))
    out = by.groupBy("concept", "value").agg(F.sum("n").alias("global_frequency"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("frequency_by_source"))
    return out.where(F.col("global_frequency") > threshold)


def block_keys(values: DataFrame, threshold: int = config.RULE2_THRESHOLD) -> DataFrame:
    """Distinct (rule, key, rid): exact values of eligible frequency, and derived keys of every record."""
    exact = values.where(F.col("concept").isin(*config.EXACT_CONCEPTS))
    out = within(exact.select("concept", "value", "rid"), ["concept", "value"], ["rid"], config.BLOCK_MIN, threshold).select(F.concat(F.lit("exact_"), "concept").alias("rule"), F.col("value").alias("key"), "rid")
    v = F.col("value")
    single = {"email_skeleton": ("email", text.email_skeleton(v)), "email_sha256_bridge": ("email", F.sha2(v, 256)), "phone_suffix_9": ("phone", text.phone_suffix(v)), "numeric_account_reference": ("account_reference", text.numeric_account(v))}
    rules = F.array(*(F.when(F.col("concept") == c, F.struct(F.lit(r).alias("rule"), k.alias("key"))) for r, (c, k) in single.items()), F.when(F.col("concept") == "hashed_email", F.struct(F.lit("email_sha256_bridge").alias("rule"), F.lower(v).alias("key"))))
    derived = values.where(F.col("concept").isin("email", "phone", "account_reference", "hashed_email")).select("rid", F.explode(F.array_compact(rules)).alias("k")).where("k.key IS NOT NULL").select("k.rule", "k.key", "rid")
    named = record_sets(values.where(F.col("concept").isin("full_name", "first_name", "last_name", "city", "date_of_birth", "postcode")), ("full_name", "first_name", "last_name", "city", "date_of_birth", "postcode"))
    # normalized values are composed and case-folded already; person_names and part only drop what isn't a letter or number
    names = text.person_names(*(F.col(f"v_{c}") for c in ("full_name", "first_name", "last_name")))
    part = lambda c: F.array_remove(F.array_distinct(F.transform(F.col(f"v_{c}"), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", ""))), "")
    composite = lambda rule, c: F.flatten(F.transform(names, lambda n: F.transform(part(c), lambda x: F.struct(F.lit(rule).alias("rule"), F.concat(n, F.lit(UNIT), x).alias("key")))))
    pairs = named.select("rid", F.explode(F.concat(composite("name_city", "city"), composite("name_date_of_birth", "date_of_birth"), composite("name_postcode", "postcode"))).alias("k")).select("k.rule", "k.key", "rid")
    return reduce(DataFrame.unionByName, (derived, pairs), out).distinct()


def record_sets(values: DataFrame, concepts: tuple[str, ...]) -> DataFrame:
    """rid and v_<concept>, the sorted distinct values of each record; empty where there are none."""
    # one list a record, parted afterwards: a buffer for each concept would be sent for every record
    rows = values.groupBy("rid").agg(F.collect_list(F.struct("concept", "value")).alias("all"))
    of = lambda c: F.transform(F.filter("all", lambda x: (x["concept"] == c) & x["value"].isNotNull()), lambda x: x["value"])
    return rows.select("rid", *(F.array_sort(F.array_distinct(of(c))).alias(f"v_{c}") for c in concepts))


def blocks(keys: DataFrame) -> DataFrame:
    """Sizes of the blocks that are kept."""
    return keys.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(config.BLOCK_MIN, config.BLOCK_MAX))


def in_blocks(keys: DataFrame) -> DataFrame:
    """The keys of blocks that are kept."""
    return within(keys, ["rule", "key"], ["rid"], config.BLOCK_MIN, config.BLOCK_MAX)


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and m, the sorted rids of each: for groups that a cap has made small."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("rid")).alias("m"))


#: All pairs (l, r), l < r, of the small sorted array m.
BLOCK_PAIRS = "flatten(transform(m, (a, i) -> transform(slice(m, i + 2, size(m)), b -> struct(a AS l, b AS r))))"


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """l, r (l < r) and rules, the sorted rules under which they meet.  A block's records, 40 at most, are gathered where the cap has put them:
    one shuffle by key and one by pair, and no join."""
    blocks_of = gathered_within(keys, ["rule", "key"], "rid", config.BLOCK_MIN, config.BLOCK_MAX)
    # rules as bits of one number: sums of a fixed size, where sets would be gathered for every pair
    bit = F.coalesce(*(F.when(F.col("rule") == r, F.lit(1 << i)) for i, r in enumerate(RULES)), F.raise_error(F.concat(F.lit("unknown rule "), "rule")).cast("int"))
    pairs = blocks_of.select(bit.alias("rule"), F.explode(F.expr(BLOCK_PAIRS)).alias("p"))
    found = pairs.groupBy("p.l", "p.r").agg(F.bit_or("rule").alias("rules"))
    return found.select("l", "r", F.array_compact(F.array(*(F.when(F.col("rules").bitwiseAND(F.lit(1 << i)) != 0, r) for i, r in enumerate(RULES)))).alias("rules"))


def rule_summary(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each rule: kept keys, memberships, pair incidences, distinct pairs and pairs no other rule finds."""
    size = blocks(keys).groupBy("rule").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("memberships"), F.sum(text.potential_pairs(F.col("n"))).alias("incidences"))
    found = pairs.select(F.explode("rules").alias("rule"), (F.size("rules") == 1).alias("only")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("only").alias("n_unique_pairs"))
    return size.join(found, "rule", "left").fillna(0)


def reduction(n_records: Column, keys: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """One row: records, all possible pairs, candidates, share cut, derived keys over the cap, records in a kept block."""
    all_pairs = text.potential_pairs(n_records).alias("all_pairs")
    n = records.agg(n_records.alias("n_records"), all_pairs)
    sized = keys.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))
    over = sized.agg(F.count_if((F.col("n") > config.BLOCK_MAX) & ~F.col("rule").startswith("exact_")).alias("oversized_keys"))
    inside = in_blocks(keys).agg(F.count_distinct("rid").alias("records_in_blocks"))
    return n.join(pairs.agg(F.count(F.lit(1)).alias("candidates"))).join(over).join(inside).withColumn("reduction_pct", F.round(100.0 * (1 - F.col("candidates") / F.col("all_pairs")), 6))
