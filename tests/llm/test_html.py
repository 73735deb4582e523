"""Pages: blocks, the field's training and decoding against brute force, and held-out layouts."""

import itertools
import random

import numpy as np
import pytest

from quernstone.llm.html_blocks import leaf_blocks
from quernstone.llm.html_extract import Field, extract_text, fit, main_text, own_labels, page_features, train, train_on

TEXT = "It was a long way down to the river, and nobody had gone there since the flood of that spring."


def test_blocks():
    html = (
        "<!DOCTYPE html><title>no</title><style>p{}</style><body><!-- no --><p>One &amp; two<br>three"
        "<p><b>four</b> <a href='/x>y'>five</a><ul><li>a<li>b</ul>tail<script>if (a<b) x('</p>')</script>"
        "<![CDATA[raw]]> 1 < 2 &lt;i&gt;"
    )
    blocks = leaf_blocks(html)
    assert [b.text for b in blocks] == ["One & two three", "four five", "a", "b", "tailraw 1 < 2 <i>"]
    assert blocks[1].linked == 4 and blocks[2].tags == ("body", "ul", "li")
    assert leaf_blocks("") == [] and leaf_blocks("<p></div></p>") == []
    assert [b.text for b in leaf_blocks("<table><tr><td>a<td>b<tr><td>c</table>d")] == ["a", "b", "c", "d"]
    assert [b.text for b in leaf_blocks("<p title=it's>x</p><p>y")][-1] == "y"


def brute(field, features):
    best = None
    for labels in itertools.product((0, 1), repeat=len(features)):
        score = field.start[labels[0]] + sum(field.pairs[a, b] for a, b in zip(labels, labels[1:]))
        score += sum(field.weights.get(f, 0) for own, y in zip(features, labels) if y for f in own)
        if best is None or score > best[0] + 1e-12:
            best = (score, labels)
    return [bool(y) for y in best[1]]


def test_viterbi_by_all_labellings():
    rng = np.random.default_rng(2)
    for _ in range(50):
        field = Field({f"f{k}": float(w) for k, w in enumerate(rng.normal(size=6))}, rng.normal(size=2), rng.normal(size=(2, 2)))
        features = [[f"f{k}" for k in rng.integers(0, 7, size=2)] for _ in range(rng.integers(1, 8))]
        assert field.decode(features) == brute(field, features)
    assert field.decode([]) == []


def test_fit_learns_features_and_chains():
    rng = random.Random(4)
    pages = []
    for _ in range(80):
        labels = [False] * rng.randint(1, 3) + [True] * rng.randint(1, 5) + [False] * rng.randint(0, 2)
        pages.append(([["bias", ("main" if y else "part") if rng.random() < 0.8 else "unclear"] for y in labels], labels))
    field = fit(pages, rounds=200)
    assert field.weights["main"] > 0 > field.weights["part"]
    assert field.decode([["bias", "part"], ["bias", "main"], ["bias", "unclear"], ["bias", "main"], ["bias", "part"]]) == [
        False, True, True, True, False,
    ]
    assert fit([]).decode([["x"]]) in ([True], [False])


@pytest.fixture(scope="module")
def pages(spark):
    try:
        return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    except Exception:
        pytest.skip("no test tables")


@pytest.fixture(scope="module")
def field(pages):
    return train_on(pages, most_pages=120)


def test_pages_not_trained_on(spark, field):
    """Pages of a larger table, whose own markup says what their article is."""
    other = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["id"]: r["text"] for r in extract_text(other, field).collect()}
    wrong = 0
    for r in other.collect():
        blocks = leaf_blocks(r["html"])
        expected = "\n".join(b.text for b, y in zip(blocks, own_labels(blocks)) if y)
        wrong += found[r["page_id"]] != expected
    assert len(found) == other.count() and wrong <= 0.01 * len(found)


def test_other_layouts(field):
    page = (
        "<html><body><div id='top-menu'><a href='/'>Home</a> <a href='/n'>News</a></div>"
        f"<div class='post-content'><h1>The river</h1><p>{TEXT}</p><div class='ad-slot'><p>Buy boats now.</p></div>"
        f"<p>{TEXT} Again.</p></div><div class='comments'><div class='comment'><p>{TEXT} I liked it.</p></div></div>"
        "<div class='cookie-notice'><p>We use cookies on this page.</p></div><div class='footer'>&copy; Someone</div>"
    )
    assert main_text(page, field) == f"The river\n{TEXT}\n{TEXT} Again."


def test_odd_pages(spark, field):
    schema = "page_id long, url string, html string, id long, text string"
    rows = [
        (1, "u", None, 1, "x"), (2, None, "", 1, "x"), (3, "u", "<script>x</script>", 1, None),
        (4, "u", f"<article><p>{TEXT}</article>", 1, "x"), (4, "u", f"<article><p>{TEXT}</article>", 1, "x"),
        (None, "u", "<article>" + f"<p>{TEXT}</p>" * 3000 + "</article>", 1, "x"),
    ]
    got = sorted((r["id"] or 0, r["text"]) for r in extract_text(spark.createDataFrame(rows, schema), field).collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 4, 4]
    assert got[1][1] == got[2][1] == got[3][1] == "" and got[4][1] == TEXT == got[5][1]
    assert got[0][1] == "\n".join([TEXT] * 3000)
    empty = spark.createDataFrame([], schema)
    assert extract_text(empty, train_on(empty)).count() == 0
    assert train(["<p>nothing is marked</p>"]).decode(page_features(leaf_blocks("<p>x</p>"))) in ([True], [False])
