import math
import re
from collections import Counter

import numpy as np
import xxhash

from kinmesh.llm import quality as Q


def long_hash(values, seed=42):
    """Spark's xxhash64 of longs: each hashed with the last one's hash as seed."""
    for v in values:
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed)
    return seed


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def grams(text):
    v = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    signed = [x - (1 << 64) if x >> 63 else x for x in v]
    return [x & Q.BUCKETS - 1 for x in v] + [long_hash(p) & Q.BUCKETS - 1 for p in zip(signed, signed[1:])]


def brute(rows, good):
    corpus, trusted = Counter(), Counter()
    for i, t in rows:
        g = grams(t)
        corpus.update(g)
        if i in good:
            trusted.update(g)
    n, g = sum(corpus.values()), sum(trusted.values())
    out = []
    for i, t in rows:
        b, w = grams(t), base(t)
        ratio = lambda x: 0.0 if not g else math.log((trusted[x] + Q.SMOOTHING * Q.BUCKETS * (p := (corpus[x] + 1) / (n + Q.BUCKETS))) / (g + Q.SMOOTHING * Q.BUCKETS)) - math.log(p)
        score = sum(map(ratio, b)) / max(1, len(b))
        failed = w[0] < 10 or 100 * w[4] > 20 * w[0]
        out.append((i, *w, failed, score))
    return out


def checked(spark, rows, labels):
    df = spark.createDataFrame([(i, t, "e", "w") for i, t in rows], "doc_id long, text string, score string, w string").repartition(3)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(rows, {d for d, q, x in labels if q == 1 and not x and d is not None})
    report = Q.quality_report(df, labelled)
    got = report.collect()
    key = lambda r: tuple(str(x) for x in r)
    got_rows = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.score, 9)) for r in got), key=key)
    assert got_rows == sorted(((*w[:-1], round(w[-1], 9)) for w in want), key=key)
    assert all(r.kept == (not r.base_failed and r.score >= Q.THRESHOLD) for r in got)
    kept = Q.keep_good(df, labelled)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    return got


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [(r.doc_id, r.text) for r in docs]
    rows += [(None, None), (900, ""), (901, " \n\t"), (902, "a b c d e a b c d e x y"), (903, "same line\nsame line\n\n same line\nsame line"), (904, "a a a a a a a a a a a a"), (905, "😀# é* $%&|<> \x0b\x0c x"), (905, "one two three four five"), (None, "w " * 3000), (906, " ".join(str(i) for i in range(20_000)))]
    labels = [(r[0], 1, i % 7 == 0) for i, r in enumerate(rows[:40])] + [(None, 1, 0), (900, 1, None), (5, 0, 0), (rows[0][0], 1, 0)]
    checked(spark, rows, [(d, q, int(t) if t is not None else None) for d, q, t in labels])


def test_no_trusted_documents(spark):
    got = checked(spark, [(1, "a b c d e f g h i j k"), (2, "x")], [(1, 0, 0)])
    assert {r.doc_id: r.kept for r in got} == {1: True, 2: False} and all(r.score == 0 for r in got)


def test_junk_goes_and_prose_stays(spark):
    prose = "the of and to in is was that for on are with as by from at this be it or".split()
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(prose, 60))) for i in range(300)] + [(1000 + i, " ".join(x + "%%%" for x in rng.choice(prose, 60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in Q.keep_good(df, labels).select("doc_id").collect()}
    assert kept == set(range(300))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality_report(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_native_plan(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    plan = Q.quality_report(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
