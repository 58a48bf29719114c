"""Queries of labels, partitions, metrics and models over the identity view and the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmesh.operators import business, evaluate, models, scoring
from kinmesh.queries.registry import registrar
from kinmesh.storage import keep

query, QUERIES, ORACLES = registrar()

LABELLED = "SELECT s.*, a.person_id AS p_l, b.person_id AS p_r, a.person_id = b.person_id AS is_match, least(a.source, b.source) || '+' || greatest(a.source, b.source) AS source_pair FROM scored s JOIN identity a ON s.l = a.rid JOIN identity b ON s.r = b.rid"
METRICS = """count(*) AS pairs, count_if(is_match) AS matches, count_if(decision = 'auto_merge') AS auto, count_if(decision = 'auto_merge' AND is_match) AS auto_true, count_if(decision = 'human_review') AS review, count_if(decision = 'human_review' AND is_match) AS review_true, count_if(decision = 'leave_separate' AND is_match) AS missed,
 round(count_if(decision = 'auto_merge' AND is_match)::DOUBLE / nullif(count_if(decision = 'auto_merge'), 0), 6) AS auto_precision, round(count_if(decision = 'auto_merge' AND is_match)::DOUBLE / nullif(count_if(is_match), 0), 6) AS auto_recall, round(count_if(decision = 'human_review' AND is_match)::DOUBLE / nullif(count_if(decision = 'human_review'), 0), 6) AS review_yield, round(count_if(decision <> 'leave_separate' AND is_match)::DOUBLE / nullif(count_if(is_match), 0), 6) AS assisted_recall"""
LINKS = "SELECT i.person_id, m.l, i.rid AS r FROM identity i JOIN (SELECT person_id, min(rid) AS l FROM identity GROUP BY ALL) m USING (person_id) WHERE i.rid <> m.l"
# documents and their labels as a scored set: the score is a ratio of counts, the truth the label
SCORED_LABELS = "SELECT l.doc_id, CAST(l.quality AS INTEGER) AS y, CAST(least(d.n_chars, 2000) AS DOUBLE) / 2000.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id)"


def _labelled(s):
    marked, kinds = s.marked  # persons are joined to the narrow rows
    return scoring.with_scores(evaluate.label_pairs(marked, s.truth), kinds)


@query(f"SELECT l, r, decision, is_match, source_pair FROM ({LABELLED})", "scored")
def labelled_pairs(s):
    return _labelled(s).select("l", "r", "decision", "is_match", "source_pair")


@query(f"SELECT {METRICS} FROM ({LABELLED})", "scored")
def pair_metrics(s):
    return evaluate.pair_metrics(_labelled(s))


@query(f"SELECT source_pair, {METRICS} FROM ({LABELLED}) GROUP BY source_pair", "scored")
def metrics_by_source_pair(s):
    return evaluate.pair_metrics(_labelled(s), "source_pair")


@query(f"SELECT event, {METRICS} FROM (SELECT *, unnest(list_transform(evidence, lambda x: 'evidence:' || x) || list_transform(conflicts, lambda x: 'conflict:' || x)) AS event FROM ({LABELLED})) GROUP BY event", "scored")
def metrics_by_event(s):
    return evaluate.by_event(_labelled(s))


@query(
    f"SELECT concept, availability, {METRICS} FROM (SELECT p.*, c.concept, ['neither', 'one', 'both'][CASE c.concept {' '.join(f'''WHEN '{c}' THEN (len(a.{c}) > 0)::INT + (len(b.{c}) > 0)::INT''' for c in ('email', 'phone', 'device_id', 'account_reference', 'provider_id'))} END + 1] AS availability FROM ({LABELLED}) p JOIN recs a ON p.l = a.rid JOIN recs b ON p.r = b.rid, (SELECT unnest(['email', 'phone', 'device_id', 'account_reference', 'provider_id']) AS concept) c) GROUP BY concept, availability",
    "scored",
)
def metrics_by_availability(s):
    return evaluate.by_availability(_labelled(s), s.records, ("email", "phone", "device_id", "account_reference", "provider_id"))


@query(f"SELECT CAST(least(floor(mct_score * 10), 9) AS INTEGER) AS band, {METRICS} FROM ({LABELLED}) GROUP BY band", "scored")
def metrics_by_score_band(s):
    return evaluate.by_score_band(_labelled(s))


@query(
    f"SELECT CASE WHEN mct_score >= 0.88 THEN 'auto' WHEN mct_score >= 0.86 THEN '0.86-0.88' WHEN mct_score >= 0.80 THEN '0.80-0.86' WHEN mct_score >= 0.70 THEN '0.70-0.80' WHEN mct_score >= 0.62 THEN '0.62-0.70' WHEN mct_score >= 0.50 THEN '0.50-0.62' ELSE 'below 0.50' END AS proximity, count(*) AS pairs, count_if(is_match) AS matches FROM ({LABELLED}) GROUP BY ALL",
    "scored",
)
def score_proximity(s):
    return _labelled(s).groupBy(evaluate.proximity(F.col("mct_score")).alias("proximity")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("is_match").alias("matches"))


@query(f"SELECT evidence[1] AS kind, count(*) AS pairs, count_if(decision = 'auto_merge') AS merged, count_if(decision = 'human_review') AS review FROM ({LABELLED}) WHERE NOT is_match AND len(evidence) > 0 GROUP BY ROLLUP (evidence[1])", "scored")
def hard_negative_outcomes(s):
    return evaluate.hard_negative_outcomes(_labelled(s))


@query(f"SELECT event, count(*) AS n FROM (SELECT unnest(evidence) AS event FROM ({LABELLED}) WHERE decision = 'auto_merge' AND NOT is_match) GROUP BY ALL", "scored")
def false_merge_features(s):
    return evaluate.false_merges(_labelled(s))


@query(
    "SELECT least(x.k, y.k) AS a, greatest(x.k, y.k) AS b, max(mct_score) AS best, arg_max(decision, (mct_score, -l, -r)) AS decision FROM scored JOIN (SELECT rid, source || '|' || source_record_id AS k FROM identity) x ON l = x.rid JOIN (SELECT rid, source || '|' || source_record_id AS k FROM identity) y ON r = y.rid WHERE x.k <> y.k GROUP BY ALL",
    "scored",
)
def logical_best_score(s):
    return evaluate.best_logical(s.scored, s.ids)


@query(
    f"SELECT decision, source_pair, array_to_string(evidence, ';') AS evidence, array_to_string(conflicts, ';') AS conflicts, count(*) AS n, CAST(sum(CAST(round(mct_score * 1000000) AS BIGINT)) AS BIGINT) AS sum_micro, min(CAST(round(mct_score * 1000000) AS BIGINT)) AS min_micro, max(CAST(round(mct_score * 1000000) AS BIGINT)) AS max_micro FROM ({LABELLED}) WHERE is_match AND decision <> 'auto_merge' GROUP BY ALL",
    "scored",
)
def unresolved_patterns(s):
    return evaluate.unresolved_patterns(_labelled(s))


@query(
    f"SELECT source_pair, links, kept, round(kept::DOUBLE / links, 6) AS recall FROM (SELECT source_pair, count(*) AS links, count(hit) AS kept FROM (SELECT least(a.source, b.source) || '+' || greatest(a.source, b.source) AS source_pair, p.l AS hit FROM ({LINKS}) k JOIN identity a ON k.l = a.rid JOIN identity b ON k.r = b.rid LEFT JOIN pairs p ON k.l = p.l AND k.r = p.r) GROUP BY ROLLUP (source_pair))",
    "pairs",
)
def blocking_recall(s):
    return evaluate.blocking_recall(evaluate.links(s.truth), s.pairs, s.truth)


@query(f"SELECT outcome, count(*) AS links FROM (SELECT coalesce(s.decision, 'blocked') AS outcome FROM ({LINKS}) k LEFT JOIN scored s ON k.l = s.l AND k.r = s.r) GROUP BY ALL", "scored")
def link_outcomes(s):
    return evaluate.link_outcomes(evaluate.links(s.truth), s.scored).groupBy("outcome").agg(F.count(F.lit(1)).alias("links"))


_C = "(SELECT *, CASE WHEN cluster_status = 'quarantined_oversized' THEN -rid ELSE component END AS c FROM assigned)"


@query(
    f"SELECT merged_pairs, true_pairs, \"both\", round(\"both\"::DOUBLE / nullif(merged_pairs, 0), 6) AS \"precision\", round(\"both\"::DOUBLE / nullif(true_pairs, 0), 6) AS recall FROM (SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM {_C} GROUP BY c)) AS merged_pairs, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM {_C} GROUP BY person_id)) AS true_pairs, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM {_C} GROUP BY c, person_id)) AS \"both\")",
    "assigned",
)
def cluster_pairwise_metrics(s):
    return evaluate.cluster_metrics(s.assigned, s.truth)


@query("SELECT count(*) AS clusters, count_if(people = 1) AS pure, count_if(people > 1) AS mixed, max(people) AS most_people FROM (SELECT component, count(DISTINCT person_id) AS people FROM assigned WHERE cluster_status = 'accepted_merged' GROUP BY ALL)", "assigned")
def cluster_purity(s):
    return evaluate.cluster_purity(s.assigned, s.truth)


_TOGETHER = f"SELECT k.l, k.r, coalesce(a.component = b.component, false) AS together FROM ({LINKS}) k LEFT JOIN (SELECT * FROM assigned WHERE cluster_status <> 'quarantined_oversized') a ON k.l = a.rid LEFT JOIN (SELECT * FROM assigned WHERE cluster_status <> 'quarantined_oversized') b ON k.r = b.rid"


@query(f"SELECT together, count(*) AS links FROM ({_TOGETHER}) GROUP BY ALL", "assigned")
def same_component(s):
    return evaluate.same_component(evaluate.links(s.truth), s.assigned).groupBy("together").agg(F.count(F.lit(1)).alias("links"))


@query(
    f"SELECT CASE WHEN together THEN 'resolved' WHEN outcome = 'blocked' THEN 'blocking' WHEN outcome = 'auto_merge' THEN 'size cap' ELSE outcome END AS stage, count(*) AS links FROM (SELECT k.l, k.r, coalesce(s.decision, 'blocked') AS outcome FROM ({LINKS}) k LEFT JOIN scored s ON k.l = s.l AND k.r = s.r) JOIN ({_TOGETHER}) USING (l, r) GROUP BY ALL",
    "assigned",
)
def pipeline_loss(s):
    of = evaluate.links(s.truth)
    return evaluate.pipeline_loss(evaluate.link_outcomes(of, s.scored), evaluate.same_component(of, s.assigned))


_FS = f"""(SELECT event, round((km + 0.5::DOUBLE) / (nm + 1.0::DOUBLE), 12) AS m, round((ku + 0.5::DOUBLE) / (nu + 1.0::DOUBLE), 12) AS u, round(log2(((km + 0.5::DOUBLE) / (nm + 1.0::DOUBLE)) / ((ku + 0.5::DOUBLE) / (nu + 1.0::DOUBLE))), 6) AS weight FROM
 (SELECT event, count_if(is_match) AS km, count_if(NOT is_match) AS ku FROM (SELECT is_match, unnest(list_transform(evidence, lambda x: 'evidence:' || x) || list_transform(conflicts, lambda x: 'conflict:' || x)) AS event FROM ({LABELLED})) GROUP BY ALL), (SELECT count_if(is_match) AS nm, count_if(NOT is_match) AS nu FROM ({LABELLED}))
 UNION ALL SELECT 'prior', NULL, NULL, round(log2((count_if(is_match) + 0.5::DOUBLE) / (count_if(NOT is_match) + 0.5::DOUBLE)), 6) FROM ({LABELLED}))"""


@query(f"SELECT event, round(m, 9) AS m, round(u, 9) AS u, round(weight, 5) AS weight FROM {_FS}", "scored")
def fs_weights(s):
    return models.fs_weights(_labelled(s)).select("event", F.round("m", 9).alias("m"), F.round("u", 9).alias("u"), F.round("weight", 5).alias("weight"))


@query(
    f"SELECT l, r, round(round(1 / (1 + pow(2.0::DOUBLE, -(coalesce(w, 0) + (SELECT weight FROM {_FS} WHERE event = 'prior')))), 6), 4) AS posterior FROM (SELECT l, r, sum(weight) AS w FROM (SELECT l, r, unnest(CASE WHEN len(evidence) + len(conflicts) = 0 THEN [NULL] ELSE list_transform(evidence, lambda x: 'evidence:' || x) || list_transform(conflicts, lambda x: 'conflict:' || x) END) AS event FROM scored) LEFT JOIN {_FS} USING (event) GROUP BY ALL)",
    "scored",
)
def fs_scores(s):
    return models.fs_scores(s.scored, models.fs_weights(_labelled(s))).select("l", "r", F.round("posterior", 4).alias("posterior"))


#: A small fixed model, so that the application of a model has SQL to be held against.
FIXED = {"intercept": -2.5, "coefficients": {"evidence:exact_account_reference": 4.0, "evidence:exact_provider_id": 4.5, "evidence:exact_verified_email": 3.0, "evidence:email_skeleton": 1.5, "evidence:exact_phone": 2.0, "conflict:name_conflict": -1.25, "conflict:account_reference_conflict": -3.0, "evidence:email_skeleton&evidence:exact_phone": 0.75}}


@query(
    "SELECT l, r, round(1 / (1 + exp(-z)), 5) AS probability FROM (SELECT l, r, -2.5::DOUBLE + CASE WHEN list_contains(evidence, 'exact_account_reference') THEN 4.0 ELSE 0.0 END + CASE WHEN list_contains(evidence, 'exact_provider_id') THEN 4.5 ELSE 0.0 END + CASE WHEN list_contains(evidence, 'exact_verified_email') THEN 3.0 ELSE 0.0 END + CASE WHEN list_contains(evidence, 'email_skeleton') THEN 1.5 ELSE 0.0 END + CASE WHEN list_contains(evidence, 'exact_phone') THEN 2.0 ELSE 0.0 END + CASE WHEN list_contains(conflicts, 'name_conflict') THEN -1.25 ELSE 0.0 END + CASE WHEN list_contains(conflicts, 'account_reference_conflict') THEN -3.0 ELSE 0.0 END + CASE WHEN list_contains(evidence, 'email_skeleton') AND list_contains(evidence, 'exact_phone') THEN 0.75 ELSE 0.0 END AS z FROM scored)",
    "scored",
)
def logistic_scores_fixed(s):
    return models.logistic_scores(s.scored, FIXED).select("l", "r", F.round("probability", 5).alias("probability"))


def _trained(s):
    marked, kinds = s.marked
    narrow = keep(evaluate.label_pairs(marked, s.truth), "labelled")
    parted = keep(evaluate.with_partition(narrow, evaluate.person_partitions(narrow, s.truth)), "parted")
    return models.train_and_select(scoring.with_scores(parted, kinds))  # scores are looked up whenever they are read


@query()
def logistic_train(s):
    """Coefficients of each penalty's model, fitted on the development partition, and whether validation selects it."""
    candidates, _, best = _trained(s)
    rows = [(m["l2"], f, float(v), best is not None and m["l2"] == best["l2"]) for m in candidates for f, v in [("intercept", m["intercept"]), *m["coefficients"].items()]]
    return s.spark.createDataFrame(rows, "l2 double, feature string, coefficient double, selected boolean")


@query()
def logistic_selection(s):
    """Validation metrics of each penalty's model and whether the gate selects it."""
    _, metrics, best = _trained(s)
    rows = [(*m.values(), m is best) for m in metrics]
    return s.spark.createDataFrame(rows, "l2 double, pairs long, matches long, false_merges long, auto_recall double, assisted_recall double, review long, selected boolean")


def _scored_labels(s):
    docs = s.table("documents").select("doc_id", (F.least("n_chars", F.lit(2000)).cast("double") / 2000.0).alias("p"))
    return s.table("labels").join(docs, "doc_id").select("doc_id", F.col("quality").cast("int").alias("y"), "p")


_BINS = f"SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM ({SCORED_LABELS}) GROUP BY ALL"


@query(_BINS)
def calibration_bins(s):
    return models.calibration_bins(_scored_labels(s))


@query(
    f"SELECT n, brier, log_loss, ece FROM (SELECT count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(-avg(CASE WHEN y = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, p))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, p))) END), 6) AS log_loss FROM ({SCORED_LABELS})), (SELECT round(sum(abs(mean_p - rate) * n) / sum(n), 5) AS ece FROM ({_BINS}))"
)
def binary_metrics(s):
    return models.binary_metrics(_scored_labels(s))


# ---------------------------------------------------------------- business


@query(
    "SELECT event_type AS source, max(ts) AS window_end, arg_max(n, (ts, n)) AS n FROM (SELECT event_type, ts, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS n, count(*) OVER (PARTITION BY event_type) AS total FROM events) WHERE n >= 2 GROUP BY ALL"
)
def dense_window(s):
    """The latest window of ten minutes with two or more events, by event type."""
    return business.dense_windows(s.table("events").select(F.col("event_type").alias("source"), "ts"), least=2).select("source", "window_end", "n")


@query(
    "SELECT rid, CASE WHEN source = 'ticketing' AND email = 'bookings@events.example' THEN 'automation' WHEN source = 'social_logins' AND email IS NULL THEN 'qa' ELSE 'none' END AS policy FROM identity",
    "identity",
)
def traffic_policy(s):
    qa, auto = (F.col("source") == "social_logins") & F.col("email").isNull(), (F.col("source") == "ticketing") & (F.col("email") == "bookings@events.example")
    return s.identity.select("rid", business.record_policy(qa, auto).alias("policy"))


_POLICY = "CASE WHEN source = 'ticketing' AND email = 'bookings@events.example' THEN 'automation' WHEN source = 'social_logins' AND email IS NULL THEN 'qa' ELSE 'none' END"


@query(f"SELECT component, CASE WHEN count_if(policy = 'qa') = count(*) THEN 'qa' WHEN count_if(policy = 'automation') = count(*) THEN 'automation' ELSE 'retained' END AS exclusion FROM (SELECT a.component, {_POLICY.replace('source', 'i.source').replace('email', 'i.email')} AS policy FROM assigned a JOIN identity i ON a.rid = i.rid) GROUP BY ALL", "assigned")
def cluster_exclusion(s):
    qa, auto = (F.col("source") == "social_logins") & F.col("email").isNull(), (F.col("source") == "ticketing") & (F.col("email") == "bookings@events.example")
    return business.cluster_exclusion(s.assigned.select("rid", "component"), s.identity.select("rid", business.record_policy(qa, auto).alias("policy")))


_BIN = "CAST(len(list_filter([0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.62,0.7,0.8,0.84,0.86,0.88], lambda b: b <= mct_score)) - 1 AS INTEGER)"


@query(
    f"SELECT bin, coalesce(n, 0) AS n, coalesce(k, 0) AS matches, round((coalesce(k, 0) + 0.5::DOUBLE) / (coalesce(n, 0) + 1), 6) AS rate FROM (SELECT CAST(unnest(range(12)) AS INTEGER) AS bin) LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n, count_if(is_match) AS k FROM ({LABELLED}) WHERE decision <> 'auto_merge' GROUP BY ALL) USING (bin)",
    "scored",
)
def score_bin_rates(s):
    return business.bin_rates(_labelled(s))


@query(
    f"SELECT least(a.component, b.component) AS a, greatest(a.component, b.component) AS b, max(mct_score) AS best FROM scored JOIN assigned a ON l = a.rid JOIN assigned b ON r = b.rid WHERE decision <> 'auto_merge' AND a.component <> b.component GROUP BY ALL",
    "assigned",
)
def unresolved_cluster_edges(s):
    return business.unresolved_edges(s.scored, s.assigned)


@query("SELECT p, value FROM (SELECT p, list_sort(list(o_totalprice))[CAST(round_even(p / 100.0::DOUBLE * (count(*) - 1), 0) AS BIGINT) + 1] AS value FROM orders, (SELECT unnest([5, 50, 95]) AS p) GROUP BY p)")
def nearest_rank_percentiles(s):
    return business.nearest_rank(s.table("orders"), "o_totalprice", (5, 50, 95))


@query()
def count_simulations(s):
    """Sampled counts of identities, by scenario and simulation."""
    edges = business.unresolved_edges(s.scored, s.assigned)
    rates = business.bin_rates(_labelled(s))
    sizes = s.assigned.select("component", "component_size").distinct()
    return business.simulate(edges, rates, sizes)
