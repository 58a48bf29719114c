"""What the identity pipeline may not do at size: work that grows with the pairs and was done several times, or on wide rows."""

import pytest
from pyspark.errors import PySparkException

from kinmesh.operators import blocking, evaluate, models, observe, scoring


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def values(spark):
    rows = [(1, "a", "email", "x.y@x.test"), (2, "b", "email", "xy@x.test"), (3, "c", "email", "x.y@x.test"), (3, "c", "phone", "0123456789"), (1, "a", "phone", "0123456789")]
    return spark.createDataFrame(rows, "rid long, source string, concept string, value string")


def test_values_are_normalized_once(spark):
    rows = spark.createDataFrame([(1, "s", 1, "1", " A@X.test "), (2, "s", 2, "2", "none"), (3, "s", 3, "3", "no address"), (4, "s", 4, "4", None), (5, "s", 5, "5", "é@x.test b@x.test")], "rid long, source string, record_ordinal int, source_record_id string, email string")
    out = observe.record_values(rows, {"s": {"email": "email"}}, "rid = 1")
    assert [tuple(r) for r in out.orderBy("rid").collect()] == [(1, "s", "email", "a@x.test", True), (5, "s", "email", "b@x.test", False)]
    plain = plan(out).split("Union")[-1].split("ArrowEvalPython")[0]
    assert plain.count("regexp_extract_all") <= 2  # one of the plain values, one of the others


def test_scores_are_looked_up(spark):
    v = values(spark)
    ids = spark.createDataFrame([(1, "a", "1"), (2, "b", "2"), (3, "c", "3")], "rid long, source string, source_record_id string")
    recs = scoring.records(v, None, v.where("rid = 1 AND concept = 'email'").select("rid", "value"), ids)
    pairs = blocking.candidate_pairs(blocking.block_keys(v))
    out = scoring.score_pairs(recs, pairs)
    assert "arrays_overlap" not in plan(out)
    plain = scoring.score(scoring.families(scoring.evidence(recs, pairs)))
    assert out.columns == plain.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))


def test_rules_of_pairs_are_numbers(spark):
    pairs = blocking.candidate_pairs(blocking.block_keys(values(spark)))
    assert "collect_set" not in plan(pairs)
    assert {(r.l, r.r): r.rules for r in pairs.collect()} == {(1, 2): ["email_skeleton"], (2, 3): ["email_skeleton"], (1, 3): ["email_sha256_bridge", "email_skeleton", "exact_email", "exact_phone", "phone_suffix_9"]}
    with pytest.raises(PySparkException, match="unknown rule"):
        blocking.candidate_pairs(spark.createDataFrame([("other", "k", 1), ("other", "k", 2)], "rule string, key string, rid long")).collect()


def labelled(spark):
    rows = [(1, 2, ["exact_email"], ["name_conflict"], True, "auto_merge"), (1, 3, ["exact_email"], [], False, "leave_separate"), (2, 3, [], [], True, "human_review")]
    return spark.createDataFrame(rows, "l long, r long, evidence array<string>, conflicts array<string>, is_match boolean, decision string")


def test_weights_read_pairs_once(spark):
    df = labelled(spark)
    out = models.fs_weights(df)
    assert "LogicalRDD" not in plan(out) and "ExistingRDD" not in plan(out)
    w = {r.event: (r.m, r.u) for r in out.collect()}
    assert w == {"evidence:exact_email": (0.5, 0.75), "conflict:name_conflict": (0.5, 0.25), "prior": (None, None)}
    assert {r.event: r.weight for r in models.fs_weights(df.limit(0)).collect()} == {"prior": 0.0}


def test_availability_is_spread_over_counts(spark):
    recs = spark.createDataFrame([(1, ["e"], []), (2, ["f"], ["p"]), (3, [], [])], "rid long, email array<string>, phone array<string>")
    out = evaluate.by_availability(labelled(spark), recs, ("email", "phone"))
    p = plan(out)
    assert p.count("Aggregate") >= 2 and p.index("Generate") < p.rindex("Aggregate")
    got = {(r.concept, r.availability): (r.pairs, r.matches, r.auto, r.auto_true, r.review, r.missed) for r in out.collect()}
    assert got == {("email", "both"): (1, 1, 1, 1, 0, 0), ("email", "one"): (2, 1, 0, 0, 1, 0), ("phone", "one"): (2, 2, 1, 1, 1, 0), ("phone", "neither"): (1, 0, 0, 0, 0, 0)}
