import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from kinmesh.llm import near_dup as N
from kinmesh.operators.graph import component_minimum


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps):
    """Smallest id of each row's component, by comparing all."""
    fps = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            break
        label = new
    return label.tolist(), [min((ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_fingerprint():
    rng = random.Random(1)
    for t in [None, "", " \t\n", "One", "ÄB É two x three", "a b c d", "a b c d e", "word " * 70_000, *(" ".join(rng.choice("abcdef") for _ in range(rng.randrange(40))) for _ in range(50))]:
        assert N.fingerprint(None if t is None else t.encode()) == brute(t)


@pytest.mark.parametrize("cover", N.COVERS)
def test_anchors_lose_no_link(cover):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
    home, _ = cover.anchors(x.view(np.int64))
    _, reach = cover.anchors(y.view(np.int64))
    hit = np.zeros(len(x), dtype=bool)
    for k in range(home.shape[1]):
        hit |= (reach == home[:, k : k + 1]).any(axis=1)
    assert hit.all() and reach.shape[1] == cover.replicas and reach.max() < 2**62


@pytest.mark.parametrize("cover", N.COVERS)
def test_hamming_covers(cover):
    code = np.random.default_rng(0).integers(0, cover.code_bits_mask + 1, 1 << 15)
    near = code ^ cover.nearest[cover.syndromes(code)]
    assert (cover.syndromes(near) == 0).all() and (np.bitwise_count(near ^ code) <= 1).all()
    assert all((cover.syndromes(pairs) == s).all() for s, pairs in enumerate(cover.at_two) if s)


def test_longer_codes_for_more_fingerprints():
    assert [N.cover(n) for n in (0, 10**6, 10**9, 10**12)] == [0, 0, 1, 2]
    assert all(len(set(c.masks)) == len(c.masks) and max(m.bit_length() for m in c.masks) == 64 for c in N.COVERS)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    rng = random.Random(seed)
    rows, words = [], [f"w{i}" for i in range(300)]
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.randrange(1, 6)):
            t = base[:]
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
    rows += [None, "", " ", None, rows[0], rows[0].upper()]
    rng.shuffle(rows)
    ids = [rng.randrange(1000) if i % 9 else None for i in range(len(rows))]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, rows)], "doc_id long, text string, fp string").repartition(3)
    fps = [brute(t) for t in rows]
    label, want = groups(ids, fps)
    got = N.near_duplicate_groups(df)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == Counter((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, want))
    near = [sum(1 for g in set(fps) if g != f and bin(f ^ g).count("1") <= 4) for f in fps]
    assert Counter((r.fingerprint, r.n_same, r.n_links) for r in got.collect()) == Counter((f"{f:016x}", fps.count(f), n) for f, n in zip(fps, near))
    stay = N.one_of_each(df)
    assert stay.columns == df.columns
    kept = [r.doc_id for r in stay.collect()]
    assert Counter(kept) == Counter(dict(zip(label, want)).values())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicate_groups(df).collect() == [] and N.one_of_each(df).collect() == []


def test_components_of_paths_and_stars(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(2000 + 2 * i, 2001 + 2 * i) for i in range(20)]
    name = list(range(5000))
    rng.shuffle(name)
    edges = [(name[a], name[b]) for a, b in edges]
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    nodes = spark.createDataFrame([(n, n * 2) for n in name], "node long, least long")
    got = {r.node: (r.root, r.root_least) for r in component_minimum(df, nodes).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: (r, 2 * r) for n, r in root.items()}


@pytest.mark.parametrize("number", range(len(N.COVERS)))
def test_each_link_comes_once(spark, number):
    rng = random.Random(5)
    fps, want = set(), set()
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.choice([3, 4])):
            b ^= 1 << bit
        a, b = (x - (1 << 64) if x >> 63 else x for x in (a, b))
        fps |= {a, b}
        want.add((min(a, b), max(a, b)))
    got = [tuple(r) for r in N.links(spark.createDataFrame([(x,) for x in fps], "fp long"), number).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_replicas_are_never_broadcast(spark):
    """Spark takes what an Arrow function returns for as small as its input: 42 replicas a fingerprint would go through the driver."""
    nodes = spark.range(2000).selectExpr("id * 7919 AS fp")
    plan = N.links(nodes, 0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
