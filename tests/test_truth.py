import json
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kinmesh.operators import audit, business, checks, evaluate, skew, truth
from kinmesh.storage import drop, keep


def setting(spark, seed=1):
    """Records of some people with values: two of them on over 40 records."""
    rng = random.Random(seed)
    values, people = set(), {r: f"P{rng.randrange(40)}" for r in range(160)}
    for r in people:
        values |= {(r, "email", f"e{rng.randrange(70)}")} | {(r, "phone", f"p{rng.randrange(50)}") for _ in range(rng.randrange(2))}
        values |= {(r, "email", "hot") for _ in range(rng.random() < 0.4)} | {(r, "phone", "0000") for _ in range(rng.random() < 0.5)}
    df = spark.createDataFrame([(r, "s", c, v) for r, c, v in sorted(values)], "rid long, source string, concept string, value string")
    who = spark.createDataFrame([(r, "s", str(r), p) for r, p in people.items()], "rid long, source string, source_record_id string, person_id string")
    return values, people, df, who


def holders(values):
    by = {}
    for r, c, v in values:
        by.setdefault((c, v), set()).add(r)
    return by


def test_pairs_of_shared_values(spark):
    values, people, df, who = setting(spark)
    by = holders(values)
    pairs = lambda test: {p for rs in by.values() if test(len(rs)) for p in combinations(sorted(rs), 2)}
    heavy, light = pairs(lambda n: n > 40), pairs(lambda n: n <= 40)
    assert sum(len(rs) > 40 for rs in by.values()) == 2
    r = truth.naive_pairs(df).first()
    assert (r.heavy_pairs, r.other_pairs, r.naive_pairs) == (len(heavy), len(light - heavy), len(heavy | light))
    same = [p for p in combinations(sorted(people), 2) if people[p[0]] == people[p[1]]]
    r = truth.true_pair_evidence(df, who).first()
    assert (r.true_pairs, r.with_evidence, r.unrecoverable) == (len(same), len(set(same) & light), len(set(same) - light))
    r = truth.incidences(df, who).first()
    every = [(a, b) for rs in by.values() for a, b in combinations(rs, 2)]
    assert (r.incidences, r.different_people) == (len(every), sum(people[a] != people[b] for a, b in every))
    root = {x: x for x in people}
    for _ in range(200):
        for rs in by.values():
            low = min(root[x] for x in rs)
            root |= {x: low for x in rs}
    (top, n), = Counter(root.values()).most_common(1)
    r = truth.naive_component(df, who).first()
    assert (r.component, r.records, r.causes) == (top, n, 2) and r.people == len({people[x] for x in root if root[x] == top})


def test_too_many_shared_values(spark):
    rows = [(r, "s", "email", f"e{k}") for r in range(41) for k in range(truth.MOST_SHARED + 1)]
    with pytest.raises(Exception, match="over-frequent"):
        truth.naive_pairs(spark.createDataFrame(rows, "rid long, source string, concept string, value string")).collect()


def test_link_and_hard_negative_files(spark, tmp_path):
    ref = lambda s, i: {"system": s, "record_id": i}
    lines = [{"record_a": ref("b", "1"), "record_b": ref("a", "2"), "evidence_mode": "email"}, {"record_a": ref("a", "2"), "record_b": ref("a", "3"), "evidence_modes": ["phone", "device"]}]
    (tmp_path / "links.jsonl").write_text("\n".join(map(json.dumps, [*lines, lines[1]])))
    links = truth.read_links(spark, str(tmp_path / "links.jsonl"))
    assert sorted((r.a, r.b, tuple(r.modes)) for r in links.collect()) == [("a|2", "a|3", ("device", "phone"))] * 2 + [("a|2", "b|1", ("email",))]
    own = spark.createDataFrame([("a|2", "a|3", ["device", "phone"]), ("a|2", "b|1", ["phone"])], "a string, b string, modes array<string>")
    people = spark.createDataFrame([("a|2", "P"), ("a|3", "Q")], "key string, person_id string")
    assert {r.fault: r.n for r in truth.link_faults(links, own, people).collect()} == {"self": 0, "unknown record": 1, "two people": 2, "other modes": 1, "repeated": 1}
    entries = [{"hard_negative_type": t, "source_records": [ref("a", "1"), ref("b", "9")][:: 1 if t == "x" else -1]} for t in ("x", "y")]
    (tmp_path / "hard.json").write_text(json.dumps(entries))
    got = truth.read_hard_negatives(spark, str(tmp_path / "hard.json"))
    assert got.count() == 2 and [tuple(r) for r in truth.hard_negative_labels(got).collect()] == [("a|1", "b|9", "y")]
    (tmp_path / "bad.json").write_text(json.dumps([{"hard_negative_type": "x", "source_records": [ref("a", "1")]}]))
    with pytest.raises(Exception, match="exactly two"):
        truth.read_hard_negatives(spark, str(tmp_path / "bad.json")).collect()


def test_guards(spark):
    parted = spark.createDataFrame([(1, 2, "P", "Q", "development"), (3, 4, "R", "R", "test")], "l long, r long, p_l string, p_r string, partition string")
    assert evaluate.released_labels(parted, "validation").collect()[0].partition == "development" and "p_l" not in evaluate.released_labels(parted, "final").columns
    evaluate.guard_partition(parted.where("l = 1"), "development")
    for bad in (lambda: evaluate.guard_partition(parted, "development"), lambda: evaluate.released_labels(parted, "all")):
        with pytest.raises(evaluate.PartitionError):
            bad()
    twice = spark.createDataFrame([("s", "1", "P"), ("s", "1", "Q"), ("s", "2", "P")], "source string, source_record_id string, person_id string")
    with pytest.raises(truth.TruthError):
        truth.checked_truth(twice)
    cover = truth.truth_coverage(spark.createDataFrame([("s", "1"), ("s", "3")], "source string, source_record_id string"), twice).first()
    assert tuple(cover) == (3, 1, 1, 1)
    assert truth.count_coverage(90, 100, 110, 105) == {"covered": True, "error": -5, "error_pct": -4.761905, "below": 0, "above": 0}
    base = {"auto_recall": 0.5, "assisted_recall": 0.6, "review": 3, "false_merges": 0}
    better = base | {"auto_recall": 0.6, "assisted_recall": 0.7}
    assert evaluate.select_model([base, better], base) is better and evaluate.select_model([base], base) is None


def test_classes(spark):
    said = spark.createDataFrame([(1, "qa"), (2, "qa"), (3, "automation"), (4, "none")], "key long, policy string")
    real = spark.createDataFrame([(1, "qa"), (2, "none"), (4, "automation"), (5, "qa")], "key long, class string")
    got = {r.of: tuple(r)[1:4] for r in truth.classification_against_truth(said, real).collect()}
    assert got == {"qa": (1, 1, 1), "automation": (0, 1, 1)}
    sims = spark.createDataFrame([("a", i, i % 5, 0) for i in range(500)], "scenario string, simulation int, reduction long, oversized long")
    r = business.scenario_summary(sims, 100).first()
    assert (r.mean, r.p05, r.p50, r.p95, r.least, r.most) == (98.0, 96, 98, 100, 96, 100)


def test_paths_and_signals(spark):
    df = spark.read.json(spark.sparkContext.parallelize(['{"Id": 1, "who": {"Email": "x@staff.test", "names": ["a", "load-test 7"]}, "more": [{"z": 1}]}', '{"Id": 2, "who": {"Email": "x@home.test", "names": ["b"]}, "more": []}', '{"Id": 3, "who": null}']))
    paths = [p for p, _ in business.flat_paths(df)]
    assert paths == ["id", "more", "who.email", "who.names"]
    assert [r[0] for r in df.orderBy("Id").select(business.qa_of(df)).collect()] == [True, False, False]


def test_checks():
    found = [checks.exact("a", 1, 1), checks.exact("b", 1, 2), checks.exact("c", None, 2), checks.about("d", 104, 100), checks.about("e", 115, 100), checks.about("f", 130, 100), checks.within("g", 5, 1, 4), checks.scaled("h", 2, 10, 0.1)]
    assert [c.verdict for c in found] == ["PASS", "FAIL", "NOT VERIFIABLE", "PASS", "WARNING", "FAIL", "FAIL", "PASS"] and not checks.passed(found)
    claims = {"summary": {"records": 420, "Rate": [1.5, {"late": 7}]}, "text": "no", "flag": True}
    assert dict(checks.find_numbers(claims)) == {"summary.records": 420, "summary.Rate.0": 1.5, "summary.Rate.1.late": 7} and list(checks.find_numbers(claims, "rate", "late")) == [("summary.Rate.1.late", 7)]
    assert checks.find_section(claims, "SUM") == claims["summary"] and checks.find_section(claims, "none") is None
    assert [c.verdict for c in checks.reconcile(claims, {"summary.records": 420, "summary.Rate.0": 1.6, "x": 1}, {"summary.Rate.0": 0.1})] == ["PASS", "PASS", "NOT VERIFIABLE"]


def test_cleaners(spark):
    rows = [("email", ' "A.b+c@Gmail.com" ', "ab@gmail.com"), ("email", "A.b@x.test", "a.b@x.test"), ("phone", "+999 0123 456 789", "123456789"), ("phone", "0000000", "0000000"), ("words", "''Ada--King''", "ada king")]
    clean = {"email": audit.clean_email, "phone": audit.clean_phone, "words": audit.clean_words}
    for kind, raw, want in rows:
        assert spark.range(1).select(clean[kind](F.lit(raw))).first()[0] == want, raw
    assert [r[0] for r in spark.createDataFrame([(x,) for x in ("", '""', "'null'", "None", "x", None)], "x string").select(audit.absent(F.col("x"))).collect()] == [True, True, True, True, False, True]


@pytest.mark.parametrize("seed", [1, 2])
def test_caps_ranks_and_hot_keys(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("aaaaaaaabcdefg"), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, rid long")
    n = Counter(k for k, _ in rows)
    assert Counter(tuple(r) for r in skew.within(df, ["k"], ["rid"], 2, 40).collect()) == Counter(r for r in rows if 2 <= n[r[0]] <= 40)
    plan = skew.within(df, ["k"], ["rid"], 2, 40)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Partial") > plan.index("Final")
    right = spark.createDataFrame([(k, ord(k)) for k in n], "k string, v int")
    kept = keep(df, "left")
    assert Counter(tuple(r) for r in skew.hot_join(kept, right, "k", rows=50, most=3).select("k", "rid", "v").collect()) == Counter((k, i, ord(k)) for k, i in rows)
    values = [rng.choice([None, *range(30)]) for _ in range(301)]
    some = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    known = sorted(v for v in values if v is not None)
    assert skew.exact_median(some, "v").first().median == (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    assert {r.p: r.value for r in business.nearest_rank(some, "v", (0, 5, 50, 95, 100)).collect()} == {p: known[round(p / 100 * (len(known) - 1))] for p in (0, 5, 50, 95, 100)}
    drop(kept)
    with pytest.raises(Exception):
        kept.sparkSession.read.parquet(kept._kept)
