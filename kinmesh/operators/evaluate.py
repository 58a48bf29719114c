"""Evaluation against truth that scoring never sees: labels, person-disjoint partitions, pair, link and cluster metrics.
Pairs inside clusters are counted in closed form, never built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh import config
from kinmesh.functions.text import potential_pairs
from kinmesh.operators.graph import components

N = F.count


class LeakError(ValueError):
    pass


def guard(df: DataFrame, *barred: str) -> DataFrame:
    """df, unless it carries a truth column."""
    if found := [c for c in df.columns if c in barred or "person_id" in c]:
        raise LeakError(f"truth columns in a scoring input: {found}")
    return df


class PartitionError(ValueError):
    pass


def guard_partition(df: DataFrame, *allowed: str) -> DataFrame:
    """df, unless a row is of another partition."""
    if bad := df.where(~F.coalesce(F.col("partition").isin(*allowed), F.lit(False))).select("partition").limit(1).collect():
        raise PartitionError(f"a row of {bad[0].partition} where only {allowed} may be")
    return df


#: Which partitions' labels a scope may see; each sees what the one before it does.
SCOPES = {"development": ("development",), "validation": ("development", "validation"), "final": ("development", "validation", "test")}


def released_labels(parted: DataFrame, scope: str) -> DataFrame:
    """The labels that a scope may see, without persons."""
    if scope not in SCOPES:
        raise PartitionError(f"unknown scope {scope}")
    return parted.where(F.col("partition").isin(*SCOPES[scope])).drop("p_l", "p_r", "s_l", "s_r")


def label_pairs(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """scored with both persons and whether they are the same."""
    side = lambda k: truth.select(F.col("rid").alias(k), F.col("person_id").alias(f"p_{k}"), F.col("source").alias(f"s_{k}"))
    out = scored.join(side("l"), "l").join(side("r"), "r")
    return out.withColumns({"is_match": F.col("p_l") == F.col("p_r"), "source_pair": F.concat_ws("+", F.least("s_l", "s_r"), F.greatest("s_l", "s_r"))})


def bucket(people: Column) -> Column:
    """0 to 99, from SHA-256 over the salt and the length-led sorted people."""
    one = lambda p: F.concat(F.lpad(F.hex(F.octet_length(F.encode(p, "utf-8"))), 8, "0"), F.hex(F.encode(p, "utf-8")))
    whole = F.concat(F.encode(F.lit(config.PARTITION_SALT), "utf-8"), F.unhex(F.array_join(F.transform(F.array_sort(people), one), "")))
    return (F.conv(F.substring(F.sha2(whole, 256), 1, 12), 16, 10).cast("long") % 100).cast("int")


def partition_of(b: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (lo, hi) in config.PARTITIONS.items():
        out = F.when((b >= lo) & (b < hi), name).otherwise(out)
    return out


def person_partitions(labelled: DataFrame, people: DataFrame) -> DataFrame:
    """person_id, component (smallest person of those linked by a pair), partition: no pair crosses partitions.
    The bucket is of all the component's people, so each component's list is gathered in one row."""
    edges = labelled.select(F.col("p_l").alias("a"), F.col("p_r").alias("b")).distinct()
    comp = components(people.select(F.col("person_id").alias("node")).distinct(), edges)
    parts = comp.groupBy("component").agg(F.collect_list("node").alias("people")).select("component", partition_of(bucket(F.col("people"))).alias("partition"))
    return comp.join(parts, "component").select(F.col("node").alias("person_id"), "component", "partition")


def with_partition(labelled: DataFrame, parts: DataFrame) -> DataFrame:
    return labelled.join(parts.select(F.col("person_id").alias("p_l"), "partition"), "p_l")


def pair_metrics(labelled: DataFrame, *by: str, times: str | None = None) -> DataFrame:
    """Precision, recall and review yield; null where nothing is divided by.  Accuracy is not given: separate pairs would drown it.  times: the column
    that says how many pairs a row stands for."""
    m, d = F.col("is_match"), F.col("decision")
    c = lambda x, n: (F.coalesce(F.sum(F.when(x, F.col(times))), F.lit(0)) if times else F.count_if(x)).alias(n)
    out = labelled.groupBy(*by).agg(
        c(F.lit(True), "pairs"), c(m, "matches"), c(d == "auto_merge", "auto"), c((d == "auto_merge") & m, "auto_true"), c(d == "human_review", "review"), c((d == "human_review") & m, "review_true"), c((d == "leave_separate") & m, "missed")
    )
    rate = lambda a, b: F.round(F.try_divide(F.col(a) * 1.0, F.col(b)), 6)
    return out.withColumns({"auto_precision": rate("auto_true", "auto"), "auto_recall": rate("auto_true", "matches"), "review_yield": rate("review_true", "review"), "assisted_recall": F.round(F.try_divide((F.col("auto_true") + F.col("review_true")) * 1.0, F.col("matches")), 6)})


def by_event(labelled: DataFrame) -> DataFrame:
    """Metrics of the pairs that carry each event."""
    events = F.array_distinct(F.concat(F.transform("evidence", lambda x: F.concat(F.lit("evidence:"), x)), F.transform("conflicts", lambda x: F.concat(F.lit("conflict:"), x))))
    return pair_metrics(labelled.withColumn("event", F.explode(events)), "event")


def by_availability(labelled: DataFrame, records: DataFrame, concepts: tuple[str, ...]) -> DataFrame:
    """Metrics by concept and whether both, one or neither record has a value of it."""
    # a digit to the base 3 for each concept: two records' digits add up to 0, 1 or 2, and pairs are counted by the sum before they are spread over concepts
    has = sum((F.when(F.size(c) > 0, F.lit(3**i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(concepts)), F.lit(0).cast("long"))
    side = lambda k: records.select(F.col("rid").alias(k), has.alias(f"has_{k}"))
    rows = labelled.select("l", "r", "is_match", "decision").join(side("r"), "r").join(side("l"), "l")
    counts = rows.groupBy("is_match", "decision", (F.col("has_l") + F.col("has_r")).alias("has")).agg(N(F.lit(1)).alias("n"))
    state = lambda i: F.element_at(F.array(F.lit("neither"), F.lit("one"), F.lit("both")), (F.floor(F.col("has") / 3**i) % 3 + 1).cast("int"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("concept"), state(i).alias("availability")) for i, c in enumerate(concepts))))
    return pair_metrics(counts.withColumn("a", each).select("*", "a.*"), "concept", "availability", times="n")


def by_score_band(labelled: DataFrame) -> DataFrame:
    """Metrics in ten bands of the score."""
    return pair_metrics(labelled.withColumn("band", F.least(F.floor(F.col("mct_score") * 10).cast("int"), F.lit(9))), "band")


def proximity(score: Column) -> Column:
    """Diagnostic bands around the two thresholds."""
    return F.when(score >= 0.88, "auto").when(score >= 0.86, "0.86-0.88").when(score >= 0.80, "0.80-0.86").when(score >= 0.70, "0.70-0.80").when(score >= 0.62, "0.62-0.70").when(score >= 0.50, "0.50-0.62").otherwise("below 0.50")


def links(truth: DataFrame) -> DataFrame:
    """Star links of each person: its smallest record to each other one."""
    least = truth.groupBy("person_id").agg(F.min("rid").alias("l"))
    return truth.join(least, "person_id").where("rid <> l").select("person_id", "l", F.col("rid").alias("r"))


def link_outcomes(of: DataFrame, scored: DataFrame) -> DataFrame:
    """Decision on each link, or blocked."""
    return of.join(scored.select("l", "r", "decision"), ["l", "r"], "left").withColumn("outcome", F.coalesce("decision", F.lit("blocked"))).drop("decision")


def blocking_recall(of: DataFrame, pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Links in all and those that blocking keeps, by source pair and (null) overall."""
    side = lambda k: truth.select(F.col("rid").alias(k), F.col("source").alias(f"s_{k}"))
    rows = of.join(side("l"), "l").join(side("r"), "r").join(pairs.select("l", "r", F.lit(1).alias("hit")), ["l", "r"], "left")
    rows = rows.withColumn("source_pair", F.concat_ws("+", F.least("s_l", "s_r"), F.greatest("s_l", "s_r")))
    out = rows.rollup("source_pair").agg(N(F.lit(1)).alias("links"), N("hit").alias("kept"))
    return out.withColumn("recall", F.round(F.col("kept") * 1.0 / F.col("links"), 6))


def hard_negative_outcomes(labelled: DataFrame) -> DataFrame:
    """Different people whose records share evidence: decisions by kind of evidence and (null) overall."""
    rows = labelled.where(~F.col("is_match") & (F.size("evidence") > 0)).withColumn("kind", F.element_at("evidence", 1))
    out = rows.rollup("kind").agg(N(F.lit(1)).alias("pairs"), F.count_if(F.col("decision") == "auto_merge").alias("merged"), F.count_if(F.col("decision") == "human_review").alias("review"))
    return out


def best_logical(scored: DataFrame, ids: DataFrame) -> DataFrame:
    """Best score of each unordered pair of logical records (source, id); the first pair wins a tie."""
    key = F.concat_ws("|", "source", "source_record_id")
    side = lambda k: ids.select(F.col("rid").alias(k), key.alias(f"k_{k}"))
    rows = scored.join(side("l"), "l").join(side("r"), "r").where("k_l <> k_r").select(F.least("k_l", "k_r").alias("a"), F.greatest("k_l", "k_r").alias("b"), "l", "r", "mct_score", "decision")
    return rows.groupBy("a", "b").agg(F.max("mct_score").alias("best"), F.max_by("decision", F.struct("mct_score", -F.col("l"), -F.col("r"))).alias("decision"))


def cluster_metrics(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: pairs merged, true pairs, both; precision and recall.  Sums of n over 2 by cluster, person, and both."""
    rows = assigned.select("rid", F.when(F.col("cluster_status") == "quarantined_oversized", -F.col("rid")).otherwise(F.col("component")).alias("c")).join(truth.select("rid", "person_id"), "rid")
    total = lambda name, *k: rows.groupBy(*k).agg(N(F.lit(1)).alias("n")).agg(F.sum(potential_pairs(F.col("n"))).alias(name))
    out = total("merged_pairs", "c").join(total("true_pairs", "person_id")).join(total("both", "c", "person_id"))
    return out.withColumns({"precision": F.round(F.try_divide(F.col("both") * 1.0, F.col("merged_pairs")), 6), "recall": F.round(F.try_divide(F.col("both") * 1.0, F.col("true_pairs")), 6)})


def human_clusters(assigned: DataFrame, truth: DataFrame, machines: DataFrame) -> DataFrame:
    """cluster_metrics without the records (rid) of machines."""
    people = truth.join(machines.select("rid"), "rid", "left_anti")
    return cluster_metrics(assigned.join(people.select("rid"), "rid", "left_semi"), people)


def cluster_purity(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: accepted clusters of several records, those with one person, and the most persons in one."""
    by = assigned.where("cluster_status = 'accepted_merged'").join(truth.select("rid", "person_id"), "rid").groupBy("component").agg(F.count_distinct("person_id").alias("people"))
    return by.agg(N(F.lit(1)).alias("clusters"), F.count_if(F.col("people") == 1).alias("pure"), F.count_if(F.col("people") > 1).alias("mixed"), F.max("people").alias("most_people"))


def same_component(of: DataFrame, assigned: DataFrame) -> DataFrame:
    """Whether the ends of each link share a cluster; quarantined records share none."""
    ok = assigned.where("cluster_status <> 'quarantined_oversized'")
    side = lambda k: ok.select(F.col("rid").alias(k), F.col("component").alias(f"c_{k}"))
    return of.join(side("l"), "l", "left").join(side("r"), "r", "left").select("l", "r", F.coalesce(F.col("c_l") == F.col("c_r"), F.lit(False)).alias("together"))


def unresolved_patterns(labelled: DataFrame) -> DataFrame:
    """True matches that weren't merged, by decision, source pair, evidence and conflicts; scores in millionths, so sums are exact."""
    micro = F.round(F.col("mct_score") * 1_000_000).cast("long")
    rows = labelled.where("is_match AND decision <> 'auto_merge'").select("decision", "source_pair", F.array_join("evidence", ";").alias("evidence"), F.array_join("conflicts", ";").alias("conflicts"), micro.alias("m"))
    return rows.groupBy("decision", "source_pair", "evidence", "conflicts").agg(N(F.lit(1)).alias("n"), F.sum("m").alias("sum_micro"), F.min("m").alias("min_micro"), F.max("m").alias("max_micro"))


def recall_gaps(labelled: DataFrame) -> DataFrame:
    """Of each partition and source pair, and over all partitions (null): matches, missed, and the share of that partition's gap."""
    rows = labelled.groupBy("partition", "source_pair").agg(F.count_if("is_match").alias("matches"), F.count_if(F.col("is_match") & (F.col("decision") != "auto_merge")).alias("missed"))
    both = rows.unionByName(rows.groupBy("source_pair").agg(F.sum("matches").alias("matches"), F.sum("missed").alias("missed")).withColumn("partition", F.lit("combined")))
    total = both.groupBy("partition").agg(F.sum("missed").alias("all_missed"))
    return both.join(total, "partition").select("partition", "source_pair", "matches", "missed", F.round(F.try_divide(F.col("missed") * 1.0, F.col("all_missed")), 6).alias("gap_share"))


def pipeline_loss(outcomes: DataFrame, together: DataFrame) -> DataFrame:
    """Links lost at each stage: blocked, scored apart, left to review, and merged but kept apart by the size cap."""
    rows = outcomes.join(together, ["l", "r"])
    loss = F.when(F.col("together"), "resolved").when(F.col("outcome") == "blocked", "blocking").when(F.col("outcome") == "auto_merge", "size cap").otherwise(F.col("outcome"))
    return rows.groupBy(loss.alias("stage")).agg(N(F.lit(1)).alias("links"))


def false_merges(labelled: DataFrame) -> DataFrame:
    """Evidence of merges of different people."""
    return labelled.where("decision = 'auto_merge' AND NOT is_match").select(F.explode("evidence").alias("event")).groupBy("event").agg(N(F.lit(1)).alias("n"))


def promotion_checks(old: dict, new: dict) -> list[tuple[str, bool]]:
    """Whether a new clustering may replace the old one: each check and its verdict."""
    return [
        ("no false merge is added", new["merged_pairs"] - new["both"] <= old["merged_pairs"] - old["both"]),
        ("precision does not fall", (new["precision"] or 0) >= (old["precision"] or 0)),
        ("recall does not fall", (new["recall"] or 0) >= (old["recall"] or 0)),
        ("true pairs are the same", new["true_pairs"] == old["true_pairs"]),
        ("no mixed cluster is added", new["mixed"] <= old["mixed"]),
        ("the largest mix does not grow", new["most_people"] <= old["most_people"]),
        ("quarantine does not grow", new["quarantined_records"] <= old["quarantined_records"]),
        ("records are the same", new["records"] == old["records"]),
    ]


def select_model(candidates: list[dict], baseline: dict | None = None) -> dict | None:
    """Of the models without a false auto-merge (and, given a baseline, better than it in both recalls): the best by auto recall, assisted
    recall, fewest reviews, strongest penalty."""
    better = lambda c: baseline is None or all(c[k] > baseline[k] for k in ("auto_recall", "assisted_recall"))
    fit = [c for c in candidates if c["false_merges"] == 0 and better(c)]
    return max(fit, key=lambda c: (c["auto_recall"], c["assisted_recall"], -c["review"], c.get("l2", 0.0)), default=None)
