import random

import pytest

from kinmesh.llm import licenses as L

NOISE = ["the thing and other words of it were not there on that day", "Nicht aulich für sch erüver enau sch der", "ingthou onst erly thandor"] * 40


@pytest.fixture(scope="module")
def model():
    return L.train(NOISE + L.ORDINARY)


def test_templates_and_variations(model):
    rng = random.Random(5)
    right = total = 0
    for family, texts in L.TEMPLATES.items():
        for t in texts:
            assert model.classify(L.words_of(t))[0] == family, t
            for _ in range(8):
                right += model.classify(L.words_of(" ".join(L._variations(rng, t, NOISE))))[0] == family
                total += 1
    assert right > 0.93 * total


def test_unknown(model):
    for t in [*L.ORDINARY, *NOISE, "", "The plate was lost and the license of the dog too.", "Licensed plumbers work under pressure."]:
        assert model.classify(L.words_of(t))[0] == L.UNKNOWN, t
    assert 0.5 <= model.least <= 0.95 and model.temperature > 0


def test_shortcut_is_exact(model):
    rng = random.Random(2)
    words = sorted({w for n in model.names for w in n.split(" ")})
    for _ in range(300):
        some = [w for w in rng.choices(words, k=12) if w not in model.cues] + ["zzz"]
        grams = [model.names[g] for g in set(L.ngrams(some)) if g in model.names]
        assert not model.settled or model.logits(grams).argmax() == 0


def test_documents(spark, sf_dir, model):
    rows = [(1, "First line.\n\nReleased under the MIT License.\nLast line.", 1), (2, None, 1), (None, "Licensed under CC BY-NC 4.0.", 1), (1, "First line.\n\nReleased under the MIT License.\nLast line.", 1), (3, "x " * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hits int")
    got = sorted((tuple(r)[:4] for r in L.scan_documents(df, model).collect()), key=str)
    assert got == sorted([(1, 3, 1, "MIT"), (1, 3, 1, "MIT"), (2, 0, 0, ""), (3, 1, 0, ""), (None, 1, 1, "CC-BY-NC")], key=str)
    assert L.scan_documents(df.where("false")).collect() == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    notices = ("under the MIT License.", "under the Apache License", "under the GNU General Public", "under CC BY-NC", "All rights reserved.")
    want = {r.doc_id for r in docs.collect() if any(n in r.text for n in notices)}
    assert {r.doc_id for r in L.scan_documents(docs).where("n_licences > 0").collect()} == want


WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so."""


def test_wrapped_notices_are_one_paragraph(model):
    n, hits = L.scan_text("A first line.\n\n" + WRAPPED + "\n\nThe end.", model)
    assert n == 3 and [(a, b, f) for a, b, f, *_ in hits] == [(2, 6, "MIT")]
    for family, notice in (("Zlib", "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"), ("EPL", "This program and the accompanying materials are made available under the terms\nof the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/")):
        assert [h[2] for h in L.scan_text(notice, model)[1]] == [family]


def test_documents_against_a_plain_classifier(spark, sf_dir, model):
    """Every hit of every document, by the regression's plain formula over each paragraph, without the short cuts."""
    import numpy as np

    def classify(words):
        grams = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}
        x = np.array(model.bias, dtype=float)
        for g in grams:
            if g in model.names:
                x = x + model.weights[model.names[g]]
        p = np.exp((x - x.max()) / model.temperature)
        p = p / p.sum()
        k = int(p.argmax())
        if not grams:
            return None
        near = [max(len(t & grams) / len(t), len(t & grams) / len(grams)) for f, t in model.templates if f == model.families[k]]
        return (model.families[k], float(p[k]), max(near)) if k and p[k] >= model.least and max(near) >= L.CONFIRM else None

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text or "" for r in docs.collect()} | {-1: WRAPPED, -2: "Released under the MIT License.\nLicensed under CC BY 4.0."}
    got = {r.doc_id: r for r in L.scan_documents(docs.unionByName(spark.createDataFrame([(k, rows[k]) for k in (-1, -2)], "doc_id long, text string")), model).collect()}
    some = 0
    for i, text in rows.items():
        want, lines, at = [], text.split("\n"), 0
        while at < len(lines):
            end = at
            while end + 1 < len(lines) and lines[at].split() and 40 <= len(lines[end].strip()) <= 120 and lines[end].strip()[-1] not in ".!?:;\"')]" and lines[end + 1].split():
                end += 1
            if hit := classify([w for x in lines[at : end + 1] for w in L.words_of(x)]) if lines[at].split() else None:
                want.append((at, end, *hit))
            elif end > at:
                want += [(n, n, *hit) for n in range(at, end + 1) if (hit := classify(L.words_of(lines[n])))]
            at = end + 1
        assert got[i].hits == ",".join(f"{a}-{b}:{f}:{p:.3f}:{s:.3f}" for a, b, f, p, s in want), i
        assert got[i].families == ",".join(sorted({w[2] for w in want})) and got[i].n_licences == len(want)
        some += len(want)
    assert some > 3
