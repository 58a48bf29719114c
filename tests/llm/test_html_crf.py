import itertools
import math
import random

import numpy as np
import pytest

from kinmesh.llm import html_crf as H


@pytest.fixture(scope="module")
def model():
    return H.trained_model()


def test_held_out(model):
    wrong = total = 0
    for page, content in H.labelled_pages(150, seed=1234):
        blocks = H.leaf_blocks(page)
        labels = H.align(blocks, content)
        assert sum(labels) == len(content)
        wrong += sum(a != b for a, b in zip(labels, model.decode(H.features(blocks))))
        total += len(labels)
    assert wrong < 0.02 * total


def test_viterbi_is_the_best_path():
    rng = random.Random(3)
    for _ in range(40):
        names = [f"f{i}" for i in range(6)]
        m = H.Model({f: (rng.gauss(0, 1), rng.gauss(0, 1)) for f in names}, [[rng.gauss(0, 1) for _ in "ab"] for _ in "ab"], [rng.gauss(0, 1) for _ in "ab"], [rng.gauss(0, 1) for _ in "ab"])
        rows = [rng.sample(names, 2) for _ in range(rng.randint(1, 6))]

        def score(y):
            s = m.begin[y[0]] + m.end[y[-1]] + sum(m.weights[f][k] for row, k in zip(rows, y) for f in row)
            return s + sum(m.turns[a][b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=len(rows)), key=score)
        assert math.isclose(score(m.decode(rows)), score(best))


def test_training_raises_likelihood_to_separate():
    pages = [([["a"], ["b"], ["a"]], [1, 0, 1]), ([["b"], ["b"]], [0, 0])] * 5
    m = H.train(pages, epochs=30)
    assert all(m.decode(rows) == labels for rows, labels in pages)


@pytest.mark.parametrize(
    "page,texts",
    [
        ("", []),
        ("plain", ["plain"]),
        ("<p>a<p>b<br>c &amp; d&nbsp;e</p>f", ["a", "b c & d e", "f"]),
        ("<ul><li>x<li>y <b>z</b></ul>", ["x", "y z"]),
        ("<script>var t='</p>';</script><p>1 < 2</p><!-- <p>no</p> -->", ["1 < 2"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p title='a>b'>ok</p><style>p{}</style><p>cut off &am", ["ok", "cut off &am"]),
        ("<div>one<div>two</div>three</div>", ["one", "two", "three"]),
        ("<p>a</p><p", ["a"]),
    ],
)
def test_leaf_blocks(page, texts):
    assert [b.text for b in H.leaf_blocks(page)] == texts


def test_articles(model):
    page = (
        '<html><body><header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>'
        "<article><h1>The title of it</h1><p>First  paragraph\n of the text, long enough to read.</p><p>All rights reserved.</p><p>Second one, with a <a href='#'>link</a> in it.</p></article>"
        '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">C d</a></li></ul></aside><form><label>Search</label><button>Go</button></form>'
        '<section id="comments"><div class="comment"><p>Nice post, I liked it.</p></div></section><footer>&copy; 2024 Site</footer></body></html>'
    )
    assert H.main_text(page, model)[0] == "The title of it\nFirst paragraph of the text, long enough to read.\nAll rights reserved.\nSecond one, with a link in it."
    assert H.main_text(None, model) == ("", 0, 0)


def test_query(spark, sf_dir, model):
    df = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<article><p>A text that stays here.</p></article>", "t"), (1, "u", "", "t")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extract_text(df).select("page_id", "text", "n_chars").collect()), key=str)
    assert got == [(1, "", 0), (1, "", 0), (None, "A text that stays here.", 23)]
    assert H.extract_text(df.where("false")).collect() == []
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert H.extract_text(pages).where("n_chars = 0").count() == 0


def test_foreign_layouts(model):
    """Layouts by hand, not by the generator: names that say nothing, a table, another language."""
    hashed = (
        '<html><body><div class="css-1q2w3e"><a href="/">Start</a><a href="/b">Blog</a><a href="/c">Shop</a></div><div class="sc-gsnTZi kkQzRt"><h1>How the mill was built</h1>'
        "<p class='css-9x8y7z'>The first stone of the mill was laid in spring, and the work went on for eleven years without a break.</p><p class='css-9x8y7z'>In the end it stood higher than the church, which the vicar didn't like at all.</p></div>"
        '<div class="css-0a9s8d"><a href="/x">Impressum</a> <a href="/y">Privacy</a></div></body></html>'
    )
    assert H.main_text(hashed, model)[0] == "How the mill was built\nThe first stone of the mill was laid in spring, and the work went on for eleven years without a break.\nIn the end it stood higher than the church, which the vicar didn't like at all."
    table = (
        "<html><body><table width=600><tr><td width=120><a href=a.html>Home</a><br><a href=b.html>News</a><br><a href=c.html>Maps</a></td><td><h1>The town of Orr</h1><p>Orr lies on the river and has had a market since the year 1204, when the duke gave it leave.</p>"
        "<p>Its bridge was built twice; the first one went with the flood of 1611, as the old books tell.</p></td></tr><tr><td colspan=2>Copyright 2001 Town</td></tr></table></body></html>"
    )
    assert H.main_text(table, model)[0] == "The town of Orr\nOrr lies on the river and has had a market since the year 1204, when the duke gave it leave.\nIts bridge was built twice; the first one went with the flood of 1611, as the old books tell."


def test_deep_pages_in_linear_time():
    import time

    began = time.time()
    page = "".join(f"<div><b>{i} " for i in range(20_000)) + "</b></div>" * 20_000 + "</i>" * 20_000
    assert len(H.leaf_blocks(page)) == 20_000 and time.time() - began < 20
