"""Queries of partitions, models chosen on them, canonical links, hard negatives and audits against truth."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from kinmesh.operators import evaluate, models, scoring, truth
from kinmesh.queries.base import Steps
from kinmesh.queries.evaluation import LINKS, METRICS, SCORED_LABELS
from kinmesh.queries.registry import registrar
from kinmesh.storage import keep

query, QUERIES, ORACLES = registrar()


class Parted:
    """Labelled pairs with their partition, written once."""

    def __init__(self, s: Steps):
        self.s = s

    @cached_property
    def _narrow(self):
        """Without scores, which each read looks up."""
        return keep(evaluate.label_pairs(self.s.marked[0], self.s.truth), "labelled")

    @cached_property
    def labelled(self):
        return scoring.with_scores(self._narrow, self.s.marked[1])

    @cached_property
    def people(self):
        return evaluate.person_partitions(self._narrow, self.s.truth)

    @cached_property
    def pairs(self):
        return scoring.with_scores(keep(evaluate.with_partition(self._narrow, self.people), "parted"), self.s.marked[1])

    def of(self, name: str):
        return self.pairs.where(F.col("partition") == name)


# ---------------------------------------------------------------- partitions and models


@query("SELECT person_id, component, partition FROM parts", "parts")
def person_partitions(s):
    """People, their component and its partition."""
    return Parted(s).people


@query("SELECT l, r, is_match, decision, partition FROM parted WHERE partition IN ('development', 'validation')", "parted")
def released_labels(s):
    """What the validation scope may see of the labels."""
    return evaluate.released_labels(Parted(s).pairs, "validation").select("l", "r", "is_match", "decision", "partition")


_GAPS = "SELECT partition, source_pair, count_if(is_match) AS matches, count_if(is_match AND decision <> 'auto_merge') AS missed FROM parted GROUP BY ALL UNION ALL SELECT 'combined', source_pair, count_if(is_match), count_if(is_match AND decision <> 'auto_merge') FROM parted GROUP BY ALL"


@query(f"SELECT partition, source_pair, matches, missed, round(missed::DOUBLE / nullif(sum(missed) OVER (PARTITION BY partition), 0), 6) AS gap_share FROM ({_GAPS})", "parted")
def recall_gaps(s):
    """By partition and source pair, and over all partitions."""
    return evaluate.recall_gaps(Parted(s).pairs)


@query(f"SELECT partition, {METRICS} FROM parted GROUP BY partition", "parted")
def metrics_by_partition(s):
    return evaluate.pair_metrics(Parted(s).pairs, "partition")


@query(
    "SELECT partition, decision, source_pair, array_to_string(rules, ';') AS rules, array_to_string(evidence, ';') AS evidence, array_to_string(conflicts, ';') AS conflicts, count(*) AS n FROM parted WHERE is_match AND decision <> 'auto_merge' GROUP BY ALL",
    "parted",
)
def unresolved_rule_patterns(s):
    """Unmerged true pairs by partition, decision, source pair, the rules that found them, evidence and conflicts."""
    text = {c: F.array_join(c, ";") for c in ("rules", "evidence", "conflicts")}
    rows = Parted(s).pairs.where("is_match AND decision <> 'auto_merge'").withColumns(text)
    return rows.groupBy("partition", "decision", "source_pair", *text).agg(F.count(F.lit(1)).alias("n"))


_EVENTS = "list_transform(evidence, lambda x: 'evidence:' || x) || list_transform(conflicts, lambda x: 'conflict:' || x)"
_FS_DEV = f"""(SELECT event, round(log2(((km + 0.5::DOUBLE) / (nm + 1.0::DOUBLE)) / ((ku + 0.5::DOUBLE) / (nu + 1.0::DOUBLE))), 6) AS weight FROM
 (SELECT event, count_if(is_match) AS km, count_if(NOT is_match) AS ku FROM (SELECT is_match, unnest({_EVENTS}) AS event FROM parted WHERE partition = 'development') GROUP BY ALL), (SELECT count_if(is_match) AS nm, count_if(NOT is_match) AS nu FROM parted WHERE partition = 'development')
 UNION ALL SELECT 'prior', round(log2((count_if(is_match) + 0.5::DOUBLE) / (count_if(NOT is_match) + 0.5::DOUBLE)), 6) FROM parted WHERE partition = 'development')"""


@query(f"SELECT event, weight FROM {_FS_DEV}", "parted")
def fs_weights_development(s):
    """Weights of the likelihood-ratio model, fitted on the development partition alone."""
    return models.fs_weights(models.fs_contract(Parted(s).of("development"))).select("event", "weight")


def _posterior(p: Parted, name: str):
    rows = p.of(name)
    scores = models.fs_scores(rows, models.fs_weights(models.fs_contract(p.of("development"))))
    return rows.drop("decision").join(scores, ["l", "r"])


@query(
    f"SELECT count(*) AS pairs, CAST(count_if(n_unseen > 0) AS BIGINT) AS with_unseen, CAST(coalesce(sum(n_unseen), 0) AS BIGINT) AS unseen_events FROM (SELECT l, r, count_if(event IS NOT NULL AND weight IS NULL) AS n_unseen FROM (SELECT l, r, unnest(CASE WHEN len(evidence) + len(conflicts) = 0 THEN [NULL] ELSE {_EVENTS} END) AS event FROM parted WHERE partition = 'validation') LEFT JOIN {_FS_DEV} USING (event) GROUP BY ALL)",
    "parted",
)
def fs_unseen_events(s):
    """Validation pairs with events that development never saw: they are scored without them."""
    p = Parted(s)
    rows = models.fs_scores(p.of("validation"), models.fs_weights(models.fs_contract(p.of("development"))))  # a row a pair
    return rows.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n_unseen") > 0).alias("with_unseen"), F.coalesce(F.sum("n_unseen"), F.lit(0)).alias("unseen_events"))


@query()
def model_selection(s):
    """The heuristic, the likelihood-ratio and the best logistic model on the validation partition, and the one that is selected.  The logistic model is
    trained: no SQL."""
    p = Parted(s)
    _, grid, best = models.train_and_select(p.pairs)
    rows = [models.model_rows(p.of("validation"), "heuristic"), models.model_rows(_posterior(p, "validation"), "likelihood_ratio")]
    if best:
        rows.append({"model": f"logistic l2={best['l2']}", **{k: v for k, v in best.items() if k != "l2"}})
    chosen = evaluate.select_model(rows)
    return s.spark.createDataFrame([(r["model"], r["pairs"], r["matches"], r["false_merges"], float(r["auto_recall"]), float(r["assisted_recall"]), r["review"], r is chosen) for r in rows], "model string, pairs long, matches long, false_merges long, auto_recall double, assisted_recall double, review long, selected boolean")


@query(
    "SELECT review_pairs, round(k::DOUBLE / nullif(n, 0), 6) AS test_yield, CAST(round_even(review_pairs * (k::DOUBLE / nullif(n, 0)), 0) AS BIGINT) AS projected_matches FROM (SELECT (SELECT count(*) FROM scored WHERE decision = 'human_review') AS review_pairs, (SELECT count(*) FROM parted WHERE partition = 'test' AND decision = 'human_review') AS n, (SELECT count_if(is_match) FROM parted WHERE partition = 'test' AND decision = 'human_review') AS k)",
    "parted",
)
def review_projection(s):
    return truth.review_projection(Parted(s).pairs, s.scored)


# ---------------------------------------------------------------- links and hard negatives

_MODES = "list_sort(list_filter([" + ", ".join(f"CASE WHEN list_has_any(a.{c}, b.{c}) THEN '{m}' END" for m, c in truth.MODES.items()) + ", CASE WHEN list_has_any(a.names, b.names) AND list_has_any(a.cities, b.cities) THEN 'name_city' END], lambda x: x IS NOT NULL))"
_LINKED = f"(SELECT k.l, k.r, {_MODES} AS modes FROM ({LINKS}) k JOIN recs a ON k.l = a.rid JOIN recs b ON k.r = b.rid)"


def _links(s):
    return truth.evidence_modes(evaluate.links(s.truth), s.records)


@query(f"SELECT l, r, array_to_string(modes, ';') AS modes, len(modes) > 0 AS recoverable FROM {_LINKED}", "recs")
def canonical_links(s):
    """Links of each person's first record to the others, with the evidence that both ends hold."""
    return _links(s).select("l", "r", F.array_join("modes", ";").alias("modes"), "recoverable")


@query(f"SELECT mode, count(*) AS links, count(hit) AS kept, round(count(hit)::DOUBLE / count(*), 6) AS recall FROM (SELECT unnest(CASE WHEN len(modes) > 0 THEN modes ELSE ['none'] END) AS mode, p.l AS hit FROM {_LINKED} k LEFT JOIN pairs p ON k.l = p.l AND k.r = p.r) GROUP BY ALL", "pairs", "recs")
def recall_by_evidence(s):
    return truth.recall_by_mode(_links(s), s.pairs)


@query(f"SELECT coalesce(s.decision, 'blocked') AS outcome, len(modes) > 0 AS recoverable, count(*) AS links FROM {_LINKED} k LEFT JOIN scored s ON k.l = s.l AND k.r = s.r GROUP BY ALL", "scored")
def link_outcomes_recoverable(s):
    return truth.outcome_split(_links(s), s.scored)


#: Neighbours in the customer table that are two people: as hard to tell apart as the view has them.
_HARD = "(SELECT least(a.source || '|' || a.source_record_id, b.source || '|' || b.source_record_id) AS a, greatest(a.source || '|' || a.source_record_id, b.source || '|' || b.source_record_id) AS b, CASE WHEN a.device_id = b.device_id THEN 'shared device' WHEN a.phone = b.phone THEN 'shared phone' ELSE 'neighbours' END AS hard_negative_type FROM identity a JOIN identity b ON a.source = 'app_users' AND b.source = 'app_users' AND b.record_ordinal = a.record_ordinal + 1 AND a.person_id <> b.person_id)"
_LOGICAL = "(SELECT DISTINCT least(x.k, y.k) AS a, greatest(x.k, y.k) AS b FROM pairs JOIN (SELECT rid, source || '|' || source_record_id AS k FROM identity) x ON l = x.rid JOIN (SELECT rid, source || '|' || source_record_id AS k FROM identity) y ON r = y.rid WHERE x.k <> y.k)"


def _hard_negatives(s):
    i = s.identity.where("source = 'app_users'")
    key = F.concat_ws("|", "source", "source_record_id")
    left = i.select((F.col("record_ordinal") + 1).alias("record_ordinal"), key.alias("k"), "person_id", "device_id", "phone")
    right = i.select("record_ordinal", key.alias("k2"), F.col("person_id").alias("p2"), F.col("device_id").alias("d2"), F.col("phone").alias("f2"))
    kind = F.when(F.col("device_id") == F.col("d2"), "shared device").when(F.col("phone") == F.col("f2"), "shared phone").otherwise("neighbours")
    return left.join(right, "record_ordinal").where("person_id <> p2").select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"), kind.alias("hard_negative_type"))


@query(f"SELECT hard_negative_type, count(*) AS total, count(hit) AS covered, round(count(hit)::DOUBLE / count(*), 6) AS rate FROM (SELECT h.hard_negative_type, p.a AS hit FROM {_HARD} h LEFT JOIN {_LOGICAL} p ON h.a = p.a AND h.b = p.b) GROUP BY ROLLUP (hard_negative_type)", "pairs")
def hard_negative_coverage(s):
    """Hard negatives that become candidates, by type and overall."""
    return truth.coverage_by(_hard_negatives(s), truth.logical_pairs(s.pairs, s.ids), "hard_negative_type")


# ---------------------------------------------------------------- audits

_TOKENS = "concept NOT IN ('full_name', 'city')"


def _tokens(s):
    return s.values.where(_TOKENS)


@query(
    f"SELECT true_pairs, with_evidence, true_pairs - with_evidence AS unrecoverable FROM (SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM identity GROUP BY person_id)) AS true_pairs, (SELECT count(*) FROM (SELECT DISTINCT a.rid, b.rid FROM own a JOIN own b ON a.concept = b.concept AND a.value = b.value AND a.rid < b.rid JOIN identity i ON a.rid = i.rid JOIN identity j ON b.rid = j.rid WHERE i.person_id = j.person_id AND a.{_TOKENS})) AS with_evidence)",
    "own",
)
def true_pair_evidence(s):
    return truth.true_pair_evidence(_tokens(s), s.truth)


_HEAVY = f"SELECT DISTINCT a.rid AS l, b.rid AS r FROM vals a JOIN high h USING (concept, value) JOIN vals b USING (concept, value) WHERE a.rid < b.rid AND {_TOKENS}"
_LIGHT = f"SELECT DISTINCT a.rid AS l, b.rid AS r FROM own a JOIN own b USING (concept, value) WHERE a.rid < b.rid AND {_TOKENS}"


@query(f"SELECT heavy_pairs, other_pairs, heavy_pairs + other_pairs AS naive_pairs FROM (SELECT (SELECT count(*) FROM ({_HEAVY})) AS heavy_pairs, (SELECT count(*) FROM ({_LIGHT} EXCEPT {_HEAVY})) AS other_pairs)", "own")
def naive_pair_union(s):
    """Pairs that share anything, each once; those under over-frequent values are counted by inclusion and exclusion."""
    return truth.naive_pairs(_tokens(s))


@query(f"SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS incidences, CAST(sum(n * (n - 1) // 2 - same) AS BIGINT) AS different_people FROM (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS same FROM (SELECT concept, value, person_id, count(*) AS n FROM vals JOIN identity USING (rid) WHERE {_TOKENS} GROUP BY ALL) GROUP BY concept, value)", "vals")
def token_incidences(s):
    return truth.incidences(_tokens(s), s.truth)


@query()
def naive_component(s):
    """The largest component that over-frequent values poison: its closure is too large for recursive SQL, so it is tested against a brute force."""
    return truth.naive_component(_tokens(s), s.truth)


@query("SELECT count(*) AS keys, count_if(m = 0) AS no_truth, count_if(n = 0) AS no_record, count_if(m <> n AND m > 0 AND n > 0) AS other_counts FROM (SELECT coalesce(a.n, 0) AS n, coalesce(b.m, 0) AS m FROM (SELECT source, source_record_id, count(*) AS n FROM identity GROUP BY ALL) a FULL JOIN (SELECT 'app_users' AS source, CAST(c_custkey AS VARCHAR) AS source_record_id, count(*) AS m FROM customer GROUP BY ALL) b USING (source, source_record_id))", "identity")
def truth_coverage(s):
    """The view's records against the customer table taken as truth: every other source is without."""
    known = s.table("customer").select(F.lit("app_users").alias("source"), F.col("c_custkey").cast("string").alias("source_record_id"))
    return truth.truth_coverage(s.ids, known)


@query("SELECT source, source_record_id, count(DISTINCT person_id) AS n FROM identity GROUP BY ALL HAVING count(DISTINCT person_id) > 1", "identity")
def truth_conflicts(s):
    return truth.truth_conflicts(s.truth)


@query("SELECT count(DISTINCT component) AS components, CAST(coalesce(sum(n), 0) AS BIGINT) AS records, count(DISTINCT person_id) AS people, CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) AS true_pairs FROM (SELECT component, person_id, count(*) AS n FROM assigned WHERE cluster_status = 'quarantined_oversized' GROUP BY ALL)", "assigned")
def quarantine_truth(s):
    return truth.quarantine_truth(s.assigned, s.truth)


@query(
    f"SELECT of, hits, false_alarms, misses, round(hits::DOUBLE / nullif(hits + false_alarms, 0), 6) AS precision, round(hits::DOUBLE / nullif(hits + misses, 0), 6) AS recall FROM (SELECT of, count_if(said = of AND real = of) AS hits, count_if(said = of AND real <> of) AS false_alarms, count_if(said <> of AND real = of) AS misses FROM (SELECT CASE WHEN p >= 0.5 THEN 'automation' ELSE 'qa' END AS said, CASE WHEN y = 1 THEN 'automation' ELSE 'qa' END AS real FROM ({SCORED_LABELS})), (SELECT unnest(['automation', 'qa']) AS of) GROUP BY of)"
)
def classes_against_truth(s):
    """Two classes told by the documents' length against their labels: the metrics of a traffic classification."""
    docs = s.table("documents").select("doc_id", (F.least("n_chars", F.lit(2000)).cast("double") / 2000.0).alias("p"))
    rows = s.table("labels").join(docs, "doc_id")
    kind = lambda c: F.when(c, "automation").otherwise("qa")
    return truth.classification_against_truth(rows.select(F.col("doc_id").alias("key"), kind(F.col("p") >= 0.5).alias("policy")), rows.select(F.col("doc_id").alias("key"), kind(F.col("quality") == 1).alias("class")))


#: SQL of what rests on partitions: its recursion takes a round for each link of the longest chain of people, which is too slow beyond the smallest
#: tables.  The driver gets none; the tests hold the queries against it on small tables.
SMALL = {n: ORACLES.pop(n) for n in ("person_partitions", "released_labels", "recall_gaps", "metrics_by_partition", "unresolved_rule_patterns", "fs_weights_development", "fs_unseen_events", "review_projection")}
