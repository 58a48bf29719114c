import math
import random
import re
from collections import Counter

import duckdb
import pytest

from kinmesh.llm import mixing


def shares(sizes: dict, total: float) -> dict:
    """Shared by weight, and the excess again, until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, fixed = {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in fixed)
        free = [s for s in order if s not in fixed]
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in fixed else left * weight[s] / w for s in order}
        fixed |= set(over)


def frame(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        source = rng.choice(["a"] * 6 + ["b", "é", "z", None, "B", ""])
        text = rng.choice([None, "", " \n"] + [" ".join("w" * rng.randint(1, 4) for _ in range(rng.randrange(1, 60)))] * 8)
        rows.append((i if i % 30 else None, text, source, "x", 1.5))
    rows += [(7, "same row here", "b", "x", 1.5)] * 4 + [(1000, None, "only empty", "x", 1.5)] + [(2000, "w " * 4000, "b", "x", 0.0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, target string, budget double").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows, df = frame(spark, seed)
    size = [len(re.findall(r"[^ \t-\r]+", r[1] or "")) for r in rows]
    by = Counter()
    for r, n in zip(rows, size):
        by[r[2]] += n
    want = shares(by, 1.5 * sum(size))
    got = mixing.mix_report(df).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], n) for r, n in zip(rows, size))
    assert sum(r.taken for r in got) == math.floor(1.5 * sum(size)) and all(0 <= r.taken <= 2 * r.size for r in got)
    sources = {}
    for r in got:
        sources.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert set(sources) == {(by[s], round(want[s], 6)) for s in by}
    for (_, target), taken in sources.items():
        assert abs(sum(taken) - target) <= max(size)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_report(df.repartition(7)).collect()))


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = Counter(con.sql(mixing.SQL).fetchall())
    got = Counter(tuple(r) for r in mixing.mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect())
    assert got == want


def test_documents(spark):
    rows, df = frame(spark, 3)
    report = mixing.mix_report(df).collect()
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    words = Counter()
    for r in got.collect():
        words[r.doc_id] += len(re.findall(r"[^ \t-\r]+", r.text))
    want = Counter()
    for r in report:
        want[r.doc_id] += r.taken
    assert +want == +words


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_report(df).collect() == [] and mixing.mixed_documents(df).collect() == []
    df = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.mix_report(df).collect()] == [(1, 0, 0, 0.0, 0)]
