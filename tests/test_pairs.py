import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kinmesh import config
from kinmesh.operators import blocking, business, cluster, evaluate, models, scoring
from kinmesh.operators.graph import components


def values(spark, rows):
    return spark.createDataFrame(rows, "rid long, source string, concept string, value string")


def test_forty_and_forty_one(spark):
    rows = [(i, "s", "email", "ok@x.test") for i in range(40)] + [(100 + i, "s", "email", "hot@x.test") for i in range(41)] + [(500, "s", "phone", "0123456789")]
    v = values(spark, rows)
    keys = blocking.block_keys(v)
    exact = {r.key for r in keys.where("rule = 'exact_email'").collect()}
    assert exact == {"ok@x.test"}
    assert {r.value for r in blocking.rule2_registry(v).collect()} == {"hot@x.test"}
    assert blocking.candidate_pairs(keys).count() == 40 * 39 // 2


def score(spark, left, right, high=(), verified=()):
    rows = [(1, "a", c, x) for c, xs in left.items() for x in xs] + [(2, "b", c, x) for c, xs in right.items() for x in xs]
    v = values(spark, rows)
    h = spark.createDataFrame(list(high) or [("none", "none")], "concept string, value string")
    ok = spark.createDataFrame(list(verified) or [(9, "none")], "rid long, value string")
    ids = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "rid long, source string, source_record_id string")
    pairs = spark.createDataFrame([(1, 2)], "l long, r long")
    return scoring.score_pairs(scoring.records(v, h, ok, ids), pairs).first()


E, P = {"email": ["a@x.test"]}, {"payment_token": ["T"]}


@pytest.mark.parametrize(
    "left,right,more,want,decision",
    [
        (E, E, {"verified": [(1, "a@x.test")]}, 0.90, "auto_merge"),
        (E, E, {}, 0.82, "human_review"),
        (E, E, {"high": [("email", "a@x.test")]}, 0.0, "leave_separate"),
        (E | P, E | P, {}, 0.87, "human_review"),
        ({"email": ["a@x.test"], "phone": ["0123456789"], "date_of_birth": ["2000-01-01"]}, {"email": ["a@x.test"], "phone": ["0999999999"], "date_of_birth": ["1990-01-01"]}, {}, 0.62, "human_review"),
        ({"email": ["a@x.test", "b@x.test"]}, {"email": ["a@x.test", "c@x.test"]}, {"verified": [(1, "b@x.test"), (2, "c@x.test")]}, 0.42, "leave_separate"),
        ({"account_reference": ["007"]}, {"account_reference": ["7"]}, {}, 0.97, "auto_merge"),
    ],
)
def test_scores(spark, left, right, more, want, decision):
    got = score(spark, left, right, **more)
    assert (round(got.mct_score, 6), got.decision) == (want, decision)


def test_household_with_other_names_is_reviewed(spark):
    got = score(spark, E | P | {"full_name": ["ada king"]}, E | P | {"full_name": ["bob king"]})
    assert got.decision == "human_review" and got.mct_score < 0.88 and "name_conflict" in got.conflicts


def test_cap_of_twelve(spark):
    ids = spark.createDataFrame([(i, "system", i, f"R{i}") for i in range(1, 27)], "rid long, source string, record_ordinal long, source_record_id string")
    edges = [(i, i + 1, 0.9, "auto_merge") for i in [*range(1, 12), *range(13, 25)]] + [(12, 26, 0.7, "human_review")]
    got = {r.rid: r for r in cluster.assign(ids, spark.createDataFrame(edges, "l long, r long, mct_score double, decision string")).collect()}
    assert {got[i].cluster_status for i in range(1, 13)} == {"accepted_merged"} and got[1].final_cluster_id.startswith("CMP-")
    assert {got[i].cluster_status for i in range(13, 26)} == {"quarantined_oversized"} and got[13].final_cluster_id == ""
    assert got[26].cluster_status == "accepted_singleton"


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    root = list(range(150))
    for _ in range(150):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.range(150).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == dict(enumerate(root))


def test_reduction_counts_overlaps_once():
    assert business.reduction([(1, 2), (2, 3)], {1: 1, 2: 1, 3: 1}) == (2, 0)
    assert business.reduction([(1, 2), (2, 3)], {1: 6, 2: 6, 3: 1}) == (0, 1)
    assert business.lower_sensitivity(333000, 23656, 10105) == 299239


def test_bins(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.1,), (0.62,), (0.8799,)], "s double").select(business.score_bin(F.col("s"))).collect()]
    assert got == [0, 1, 7, 11]
    with pytest.raises(Exception, match="outside the bins"):
        spark.createDataFrame([(0.88,)], "s double").select(business.score_bin(F.col("s"))).collect()


def test_dense_window(spark):
    rows = [("a", f"2026-01-01 00:00:{i:02d}") for i in range(20)] + [("a", f"2026-01-02 00:00:{i:02d}") for i in range(10)]
    df = spark.createDataFrame(rows, "source string, t string").select("source", F.col("t").cast("timestamp").alias("ts"))
    r = business.dense_windows(df, seconds=60, least=10).first()
    assert str(r.window_end) == "2026-01-02 00:00:09" and r.n == 10 and str(r.window_start) == "2026-01-01 23:59:09"


def test_models(spark):
    rows = [(i, i + 50, ["exact_device_id", "exact_email"], [], True) for i in range(5)] + [(i, i + 50, ["exact_device_id"], ["name_conflict"], False) for i in range(5, 10)]
    df = spark.createDataFrame(rows, "l long, r long, evidence array<string>, conflicts array<string>, is_match boolean")
    w = {r.event: r.weight for r in models.fs_weights(df).collect()}
    assert w["evidence:exact_email"] > 0 and abs(w["evidence:exact_device_id"]) < 0.01 and w["conflict:name_conflict"] < 0
    scored = models.fs_scores(df, models.fs_weights(df)).collect()
    assert all((r.posterior > 0.5) == (r.l < 5) for r in scored)
    assert len(models.feature_names()) == 190
    model = models.train_logistic(df, 0.001)
    p = {r.l: r.probability for r in models.logistic_scores(df, model).collect()}
    assert min(p[i] for i in range(5)) > max(p[i] for i in range(5, 10))
    with pytest.raises(models.UnknownEvent):
        models.encode([["evidence:unheard_of"]])


def test_partitions_are_person_disjoint(spark):
    rng = random.Random(3)
    people = spark.createDataFrame([(i, f"P{i % 60}") for i in range(120)], "rid long, person_id string")
    pairs = spark.createDataFrame([(f"P{rng.randrange(60)}", f"P{rng.randrange(60)}") for _ in range(30)], "p_l string, p_r string")
    part = {r.person_id: r.partition for r in evaluate.person_partitions(pairs, people).collect()}
    assert len(part) == 60 and set(part.values()) <= set(config.PARTITIONS)
    assert all(part[r.p_l] == part[r.p_r] for r in pairs.collect())


def test_guard(spark):
    with pytest.raises(evaluate.LeakError):
        evaluate.guard(spark.createDataFrame([(1, "P")], "rid long, person_id string"))
    assert evaluate.select_model([{"false_merges": 1, "auto_recall": 1.0, "assisted_recall": 1.0, "review": 0}]) is None


def test_simulations_and_scenarios(spark):
    edges = spark.createDataFrame([(1, 2, 0.7), (2, 3, 0.55), (10, 11, 0.3)], "a long, b long, best double")
    sizes = spark.createDataFrame([(x, 1) for x in (1, 2, 3, 10, 11)], "component long, component_size int")
    rates = spark.createDataFrame([(b, 10**9, 10**9) for b in range(12)], "bin int, n long, matches long")  # every edge is drawn
    rows = business.simulate(edges, rates, sizes).collect()
    assert len({(r.scenario, r.simulation) for r in rows}) == len(rows) == 2 * config.SIMULATIONS == 1000
    assert {(r.scenario, r.reduction, r.oversized) for r in rows} == {("review_only", 1, 0), ("all_unresolved", 3, 0)}
    none = business.simulate(edges.where("best < 0.6"), rates, sizes).where("scenario = 'review_only'").collect()
    assert len(none) == 500 and {r.reduction for r in none} == {0}


def test_bucket_is_of_all_people(spark):
    people = spark.createDataFrame([(i, f"P{i}é" if i % 2 else f"Q{i}") for i in range(60)], "rid long, person_id string")
    name = {r.rid: r.person_id for r in people.collect()}
    groups = [[name[j] for j in range(i, i + 3)] for i in range(0, 30, 3)] + [[name[i]] for i in range(30, 60)]
    pairs = spark.createDataFrame([(g[0], x) for g in groups for x in g[1:]], "p_l string, p_r string")
    want, buckets = {}, {}
    for g in groups:
        h = hashlib.sha256(config.PARTITION_SALT.encode())
        for p in sorted(g):
            h.update(len(p.encode()).to_bytes(4, "big") + p.encode())
        buckets[tuple(g)] = b = int(h.hexdigest()[:12], 16) % 100
        want |= dict.fromkeys(g, next(k for k, (lo, hi) in config.PARTITIONS.items() if lo <= b < hi))
    got = spark.createDataFrame([(list(g),) for g in buckets], "g array<string>").select("g", evaluate.bucket(F.col("g")).alias("b")).collect()
    assert {tuple(r.g): r.b for r in got} == buckets
    assert {r.person_id: r.partition for r in evaluate.person_partitions(pairs, people).collect()} == want


def test_grid_is_fitted_on_development_and_selected_on_validation(spark):
    def parted(flip):
        rows = []
        for name in config.PARTITIONS:
            turn = flip and name != "development"
            rows += [(len(rows) + i, 10**6, ["exact_account_reference", "exact_email"] if i % 2 else ["exact_device_id"], [], (i % 2 == 1) != turn, name) for i in range(40)]
        return spark.createDataFrame(rows, "l long, r long, evidence array<string>, conflicts array<string>, is_match boolean, partition string")

    fitted, metrics, best = models.train_and_select(parted(False))
    assert [m["l2"] for m in fitted] == [m["l2"] for m in metrics] == list(config.L2_STRENGTHS)
    assert all(m["pairs"] == 40 and m["matches"] == 20 for m in metrics) and best["false_merges"] == 0 and best["auto_recall"] == 1.0
    assert best["l2"] == max(m["l2"] for m in metrics if m["auto_recall"] == 1.0)
    again, turned, none = models.train_and_select(parted(True))
    assert again == fitted and all(m["false_merges"] == 20 for m in turned if m["l2"] <= best["l2"])
    assert none is None or none["l2"] > best["l2"] and none["auto_recall"] == 0.0  # a penalty under which nothing is merged
