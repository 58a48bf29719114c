"""Queries of normalization, profiling, blocking, scoring and clustering over the identity view."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmesh.functions import text
from kinmesh.operators import blocking, cluster, observe, profile, scoring
from kinmesh.queries.registry import registrar

PRESENT = "profiling_key IS NOT NULL AND canonical_concept <> 'source_record_id'"
GLOBAL = f"SELECT canonical_concept, profiling_key, count(DISTINCT rid) AS global_frequency, count(DISTINCT source) AS n_sources, min(raw_value) AS representative FROM obs WHERE {PRESENT} GROUP BY ALL"
MASK = """CASE WHEN canonical_concept = 'email' AND contains(profiling_key, '@') THEN coalesce(nullif(left(split_part(profiling_key, '@', 1), 1), ''), '*') || '***@' || left(split_part(split_part(profiling_key, '@', 2), '.', 1), 1) || '***' || regexp_extract(split_part(profiling_key, '@', 2), '(\\..*)$', 1)
 WHEN canonical_concept = 'phone' THEN repeat('*', greatest(4, length(profiling_key) - 2)) || right(profiling_key, 2)
 WHEN length(profiling_key) <= 2 THEN repeat('*', length(profiling_key)) WHEN length(profiling_key) <= 6 THEN left(profiling_key, 1) || '***' ELSE left(profiling_key, 3) || '…' || right(profiling_key, 2) END"""
HASH = "sha256(canonical_concept || chr(0) || profiling_key)"

query, QUERIES, ORACLES = registrar()


def _concept(name, concept):
    @query(f"SELECT rid, raw_value, normalized_value, normalization_status AS status, quality_flags AS flags FROM obs WHERE canonical_concept = '{concept}'", "obs")
    def run(s):
        return s.obs.where(F.col("canonical_concept") == concept).select("rid", "raw_value", "normalized_value", F.col("normalization_status").alias("status"), F.array_join("quality_flags", ";").alias("flags"))

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


for _name, _c in (("normalize_email", "email"), ("normalize_phone", "phone"), ("normalize_identifier", "device_id"), ("normalize_city", "city"), ("normalize_name", "full_name")):
    _concept(_name, _c)


@query("SELECT source, record_ordinal, source_record_id, raw_field, canonical_concept, raw_value, profiling_key, normalized_value, normalization_status, normalization_changed, transformation, quality_flags, evidence_role FROM obs", "obs")
def observations_long(s):
    return s.obs.drop("rid").withColumn("quality_flags", F.array_join("quality_flags", ";"))


@query(
    "SELECT source, raw_field, canonical_concept, count(*) AS total, count_if(normalization_status = 'missing') AS missing, count_if(normalization_status = 'valid') AS valid, count_if(normalization_status = 'invalid') AS invalid, count_if(normalization_changed) AS changed, count_if(quality_flags <> '') AS flagged, round(count_if(normalization_status = 'valid') * 100.0::DOUBLE / count(*), 6) AS valid_pct, round(count_if(normalization_status = 'missing') * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM obs GROUP BY ALL",
    "obs",
)
def observation_stats(s):
    return observe.field_statistics(s.obs)


@query("SELECT source, raw_field, canonical_concept, flag, count(*) AS n FROM (SELECT source, raw_field, canonical_concept, unnest(string_split(quality_flags, ';')) AS flag FROM obs WHERE quality_flags <> '') GROUP BY ALL", "obs")
def observation_issues(s):
    return observe.issues(s.obs)


@query("SELECT source, raw_field, canonical_concept, transformation, count(*) AS n FROM obs GROUP BY ALL", "obs")
def observation_transformations(s):
    return observe.transformations(s.obs)


@query("SELECT DISTINCT canonical_concept, raw_value, profiling_key FROM obs", "obs")
def profiling_keys(s):
    return s.obs.select("canonical_concept", "raw_value", "profiling_key").distinct()


@query(f"SELECT DISTINCT canonical_concept, profiling_key, {MASK} AS masked FROM obs WHERE {PRESENT}", "obs")
def value_masks(s):
    return s.obs.where(PRESENT).select("canonical_concept", "profiling_key", text.mask(F.col("canonical_concept"), F.col("profiling_key")).alias("masked")).distinct()


@query(f"SELECT DISTINCT canonical_concept, profiling_key, {HASH} AS value_hash FROM obs WHERE {PRESENT}", "obs")
def value_hashes(s):
    return s.obs.where(PRESENT).select("canonical_concept", "profiling_key", text.value_hash(F.col("canonical_concept"), F.col("profiling_key")).alias("value_hash")).distinct()


@query(f"SELECT source, raw_field, canonical_concept, raw_value, profiling_key, count(*) AS n FROM obs WHERE {PRESENT} GROUP BY ALL", "obs")
def value_counts(s):
    return profile.value_counts(s.obs)


@query(
    "SELECT source, raw_field, canonical_concept, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (profiling_key IS NULL), 0) AS BIGINT) AS missing, count_if(profiling_key IS NOT NULL) AS n_distinct, coalesce(max(n) FILTER (profiling_key IS NOT NULL), 0) AS max_frequency, count_if(profiling_key IS NOT NULL AND n = 1) AS f_1, count_if(profiling_key IS NOT NULL AND n BETWEEN 2 AND 5) AS f_2_5, count_if(profiling_key IS NOT NULL AND n BETWEEN 6 AND 20) AS f_6_20, count_if(profiling_key IS NOT NULL AND n BETWEEN 21 AND 40) AS f_21_40, count_if(profiling_key IS NOT NULL AND n > 40) AS f_over_40, CAST(coalesce(sum(n) FILTER (profiling_key IS NOT NULL), 0) - count_if(profiling_key IS NOT NULL) AS BIGINT) AS duplicates, round(count_if(profiling_key IS NOT NULL)::DOUBLE / nullif(coalesce(sum(n) FILTER (profiling_key IS NOT NULL), 0), 0)::DOUBLE, 6) AS uniqueness FROM (SELECT source, raw_field, canonical_concept, profiling_key, count(*) AS n FROM obs GROUP BY ALL) GROUP BY ALL",
    "obs",
)
def column_profile(s):
    return profile.column_profile(s.obs)


@query(f"SELECT canonical_concept, count(*) AS n_keys, CAST(sum(global_frequency) AS BIGINT) AS incidences, max(global_frequency) AS max_frequency, count_if(global_frequency > 40) AS n_high FROM ({GLOBAL}) GROUP BY ALL", "obs")
def concept_summary(s):
    return profile.concept_summary(s.obs)


@query(
    f"SELECT source, raw_field, canonical_concept, profiling_key, count(*) AS field_frequency, any_value(source_frequency) AS source_frequency, any_value(global_frequency) AS global_frequency, any_value(n_sources) AS n_sources FROM obs JOIN (SELECT source, canonical_concept, profiling_key, count(DISTINCT rid) AS source_frequency FROM obs WHERE {PRESENT} GROUP BY ALL) USING (source, canonical_concept, profiling_key) JOIN ({GLOBAL}) USING (canonical_concept, profiling_key) WHERE {PRESENT} GROUP BY ALL",
    "obs",
)
def identifier_frequency(s):
    return profile.identifier_frequency(s.obs)


@query(
    f"SELECT CAST(sum(global_frequency * (global_frequency - 1) // 2) AS BIGINT) AS pairs_before, CAST(coalesce(sum(global_frequency * (global_frequency - 1) // 2) FILTER (global_frequency > 40), 0) AS BIGINT) AS pairs_removed, count_if(global_frequency > 40) AS n_high, CAST(coalesce(sum(global_frequency * (global_frequency - 1) // 2) FILTER (global_frequency <= 40), 0) AS BIGINT) AS pairs_left, (SELECT count(DISTINCT rid) FROM obs JOIN ({GLOBAL}) USING (canonical_concept, profiling_key) WHERE {PRESENT} AND global_frequency > 40) AS records_affected FROM ({GLOBAL})",
    "obs",
)
def pair_diagnostics(s):
    return profile.pair_diagnostics(s.obs)


@query(f"SELECT canonical_concept, profiling_key, global_frequency, n_sources, {HASH} AS value_hash, {MASK} AS masked, global_frequency * (global_frequency - 1) // 2 AS potential_pairs FROM ({GLOBAL}) WHERE global_frequency > 40", "obs")
def rule2_registry_raw(s):
    return profile.registry(profile.global_frequency(s.obs)).drop("frequency_by_source")


@query(f"SELECT canonical_concept, global_frequency, n_sources, {HASH} AS value_hash, {MASK} AS masked, global_frequency * (global_frequency - 1) // 2 AS potential_pairs FROM ({GLOBAL}) WHERE global_frequency > 40", "obs")
def rule2_registry_public(s):
    return profile.public_registry(profile.registry(profile.global_frequency(s.obs))).drop("frequency_by_source")


@query(
    f"SELECT w.worst_field, w.worst_missing, t.* FROM (SELECT source || '.' || raw_field AS worst_field, round(m / n, 6) AS worst_missing FROM (SELECT source, raw_field, count_if(profiling_key IS NULL)::DOUBLE AS m, count(*)::DOUBLE AS n FROM obs GROUP BY ALL) ORDER BY m / n DESC, source, raw_field LIMIT 1) w, (SELECT canonical_concept, {HASH} AS top_hash, global_frequency FROM ({GLOBAL}) ORDER BY global_frequency DESC, canonical_concept, profiling_key LIMIT 1) t",
    "obs",
)
def quality_summary(s):
    return profile.quality_summary(s.obs)


@query("SELECT concept, value, global_frequency, by_source FROM high JOIN (SELECT concept, value, string_agg(source || '=' || n, ';' ORDER BY source) AS by_source FROM (SELECT concept, value, source, count(*) AS n FROM vals GROUP BY ALL) GROUP BY ALL) USING (concept, value)", "high")
def rule2_registry(s):
    return s.high.select("concept", "value", "global_frequency", F.array_join(F.transform(F.map_entries("frequency_by_source"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("by_source"))


@query("SELECT rule, key, rid FROM keys", "keys")
def block_keys(s):
    return s.keys


@query("SELECT rule, key, n FROM blk", "blk")
def block_sizes(s):
    return blocking.blocks(s.keys)


@query("SELECT l, r, array_to_string(rules, ';') AS rules, CAST(len(rules) AS INTEGER) AS n_rules FROM pairs", "pairs")
def candidate_pairs(s):
    """The flagship: which records deserve comparison, and why."""
    return s.pairs.select("l", "r", F.array_join("rules", ";").alias("rules"), F.size("rules").alias("n_rules"))


@query(
    "SELECT b.rule, b.n_keys, b.memberships, b.incidences, coalesce(p.n_pairs, 0) AS n_pairs, coalesce(p.n_unique_pairs, 0) AS n_unique_pairs FROM (SELECT rule, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS memberships, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS incidences FROM blk GROUP BY ALL) b LEFT JOIN (SELECT rule, count(*) AS n_pairs, count_if(single) AS n_unique_pairs FROM (SELECT unnest(rules) AS rule, len(rules) = 1 AS single FROM pairs) GROUP BY ALL) p ON b.rule = p.rule",
    "blk", "pairs",
)
def blocking_rule_summary(s):
    return blocking.rule_summary(s.keys, s.pairs)


@query(
    "SELECT n_records, n_records * (n_records - 1) // 2 AS all_pairs, candidates, oversized_keys, records_in_blocks, round(100.0::DOUBLE * (1 - candidates::DOUBLE / (n_records * (n_records - 1) // 2)::DOUBLE), 6) AS reduction_pct FROM (SELECT (SELECT count(*) FROM identity) AS n_records, (SELECT count(*) FROM pairs) AS candidates, (SELECT count(*) FROM (SELECT rule, key FROM keys WHERE NOT starts_with(rule, 'exact_') GROUP BY ALL HAVING count(*) > 40)) AS oversized_keys, (SELECT count(DISTINCT rid) FROM kept) AS records_in_blocks)",
    "pairs", "kept",
)
def blocking_reduction(s):
    return blocking.reduction(F.count(F.lit(1)), s.keys, s.pairs, s.ids)


_FEATURES = "same_source_record_id exact_account_reference exact_provider_id exact_verified_email exact_email email_skeleton exact_phone phone_suffix_9 exact_device_id name_city".split()


@query(f"SELECT l, r, {', '.join(_FEATURES)} FROM evid", "evid")
def pair_evidence(s):
    return scoring.evidence(s.records, s.pairs).select("l", "r", *_FEATURES)


@query("SELECT l, r, c_account AS account_reference_conflict, c_verified AS verified_email_conflict, c_email AS email_conflict, c_phone AS phone_conflict, c_name AS name_conflict FROM fams", "fams")
def pair_conflicts(s):
    return scoring.evidence(s.records, s.pairs).select("l", "r", *(f"{c}_conflict" for c in ("account_reference", "verified_email", "email", "phone", "name")))


@query("SELECT l, r, array_to_string(rules, ';') AS rules, array_to_string(evidence, ';') AS evidence, array_to_string(conflicts, ';') AS conflicts, round(positive_score, 5) AS positive_score, round(conflict_penalty, 5) AS conflict_penalty, round(mct_score, 5) AS mct_score, decision FROM scored", "scored")
def mct_scores(s):
    """Scores at five decimals: the sixth differs between engines only at exact ties."""
    joined = [F.array_join(c, ";").alias(c) for c in ("rules", "evidence", "conflicts")]
    return s.scored_plan.select("l", "r", *joined, *(F.round(c, 5).alias(c) for c in ("positive_score", "conflict_penalty", "mct_score")), "decision")


@query("SELECT decision, count(*) AS n, round(avg(mct_score), 4) AS mean_score, min(mct_score) AS min_score, max(mct_score) AS max_score FROM scored GROUP BY ALL", "scored")
def mct_decision_summary(s):
    return scoring.decision_summary(s.scored_plan)


@query("SELECT event, decision, count(*) AS n FROM (SELECT unnest(evidence) AS event, decision FROM scored) GROUP BY ALL", "scored")
def mct_feature_summary(s):
    return scoring.event_summary(s.scored_plan, "evidence")


@query("SELECT event, decision, count(*) AS n FROM (SELECT unnest(conflicts) AS event, decision FROM scored) GROUP BY ALL", "scored")
def mct_conflict_summary(s):
    return scoring.event_summary(s.scored_plan, "conflicts")


@query("SELECT CAST(len(evidence) AS INTEGER) AS n_families, decision, count(*) AS n FROM scored GROUP BY ALL", "scored")
def mct_family_summary(s):
    return s.scored_plan.groupBy(F.size("evidence").alias("n_families"), "decision").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rid, component FROM comp", "comp")
def components(s):
    return s.assigned.select("rid", "component")


@query("SELECT rid, component, component_size, cluster_status FROM assigned", "assigned")
def cluster_assignments(s):
    return s.assigned.select("rid", "component", "component_size", "cluster_status")


@query(
    "SELECT component, 'CMP-' || substr(sha256(unhex(string_agg(hex(one), '' ORDER BY source, record_ordinal, source_record_id))), 1, 20) AS final_cluster_id FROM (SELECT component, source, record_ordinal, source_record_id, unhex(printf('%08X', octet_length(encode(source))) || hex(encode(source)) || printf('%08X', octet_length(encode(record_ordinal::VARCHAR))) || hex(encode(record_ordinal::VARCHAR)) || printf('%08X', octet_length(encode(source_record_id))) || hex(encode(source_record_id))) AS one FROM assigned WHERE cluster_status <> 'quarantined_oversized') GROUP BY component",
    "assigned",
)
def cluster_ids(s):
    return s.assigned.where("final_cluster_id <> ''").select("component", "final_cluster_id").distinct()


@query("SELECT component_size, cluster_status, count(DISTINCT component) AS components, count(*) AS records FROM assigned GROUP BY ALL", "assigned")
def cluster_size_distribution(s):
    return cluster.size_distribution(s.assigned)


@query("SELECT count(DISTINCT component) AS components, count(DISTINCT component) FILTER (bad) AS quarantined_components, count(*) FILTER (bad) AS quarantined_records, count(DISTINCT component) - count(DISTINCT component) FILTER (bad) + count(*) FILTER (bad) AS identities FROM (SELECT *, cluster_status = 'quarantined_oversized' AS bad FROM assigned)", "assigned")
def cluster_identity_count(s):
    return cluster.identity_count(s.assigned)


@query("SELECT component, count(*) AS n FROM assigned GROUP BY ALL ORDER BY n DESC, component LIMIT 1", "assigned")
def largest_component(s):
    return cluster.largest_component(s.assigned)


@query(
    "SELECT component, records, sources, edges, min_score, max_score, mean_score FROM (SELECT component, count(*) AS records, count(DISTINCT source) AS sources FROM assigned WHERE cluster_status = 'quarantined_oversized' GROUP BY ALL) JOIN (SELECT component, count(*) AS edges, min(mct_score) AS min_score, max(mct_score) AS max_score, round(avg(mct_score), 4) AS mean_score FROM scored JOIN assigned ON l = rid WHERE decision = 'auto_merge' AND cluster_status = 'quarantined_oversized' GROUP BY ALL) USING (component)",
    "assigned",
)
def quarantine_profile(s):
    return cluster.quarantine_profile(s.assigned, s.scored)


@query("SELECT l, r, decision, mct_score FROM scored WHERE NOT ((decision = 'auto_merge' AND mct_score >= 0.88) OR (decision = 'human_review' AND mct_score >= 0.62 AND mct_score < 0.88) OR (decision = 'leave_separate' AND mct_score < 0.62))", "scored")
def edge_faults(s):
    return cluster.edge_faults(s.scored).select("l", "r", "decision", "mct_score")
