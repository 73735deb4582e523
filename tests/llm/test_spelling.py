"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import LOWER
from quernstone.llm import spelling
from quernstone.llm.spelling import CountTrie, group_counts, one_edit_apart, spelling_variants, word_counts


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def vocabulary(seed, n, letters="abcxyzéß", longest=7):
    draw = random.Random(seed)
    return sorted({"".join(draw.choice(letters) for _ in range(draw.randrange(1, longest))) for _ in range(n)})


def by_definition(counts, least=5, times=5):
    counts = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in counts if apart(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {
        (w, n, len(near[w]), form[w], counts.get(form[w]), root(w)) for w, n in counts.items()
    }


def rows_of(df):
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def test_one_edit_apart():
    words = vocabulary(1, 300, "ab", 6)
    assert all(one_edit_apart(a, b) == apart(a, b) for a in words for b in words)


def test_trie_meets_each_near_pair_once():
    words = vocabulary(2, 900)
    counts = group_counts(words)
    trie = CountTrie(words, counts)
    found = [tuple(sorted(pair)) for pair in trie.near(words, counts)]
    assert sorted(found) == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and apart(a, b)]
    # The same pairs come from all parts that a word's search leads to.
    asked = [(k, top) for k in range(len(words)) for top in spelling._reachable(tuple(counts[k, :3].tolist()))]
    rows = [k for k, _ in asked]
    parts = trie.near([words[k] for k in rows], counts[rows], np.array([top for _, top in asked]))
    assert sorted(tuple(sorted((rows[q], k))) for q, k in parts) == sorted(found)


def test_group_counts():
    assert group_counts(["", "aab"], 5).tolist() == [[0] * 5, [0, 0, 2, 1, 0]]


@pytest.mark.parametrize("part", [20_000, 7])
def test_variants_are_those_of_the_definition(spark, monkeypatch, part):
    # Small parts: places with more words than a part holds are dealt out over several.
    monkeypatch.setattr(spelling, "PART_WORDS", part)
    draw = random.Random(3)
    counts = {w: int(draw.paretovariate(0.4)) + 3 for w in vocabulary(4, 500, "abé", 8)}
    df = spark.createDataFrame([(w, min(n, 10**12), "x") for w, n in counts.items()], "word string, n long, top string")
    found = rows_of(spelling_variants(df))
    assert found == by_definition({w: min(n, 10**12) for w, n in counts.items()})
    assert sum(f[3] is not None for f in found) > 20


def test_long_chains_of_forms(spark):
    words = ["a" * k for k in range(1, 28)]
    df = spark.createDataFrame([(w, 5 ** (k + 1)) for k, w in enumerate(words[:26])], "word string, n long")
    assert {r["root"] for r in spelling_variants(df).collect()} == {words[25]}


def test_odd_words(spark, none):
    assert spelling_variants(none.selectExpr("word", "size as n")).collect() == []
    rows = [(None, 9), ("", 9), ("a", 50), ("b" * 3000, 7), ("b" * 3001, 70), ("x", 4)]
    found = rows_of(spelling_variants(spark.createDataFrame(rows, "word string, n long")))
    assert found == by_definition({w: n for w, n in rows if w is not None})


def plain_counts(rows, drop=None):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{key}:{run}".encode())
            if drop and key is not None and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return counts


@pytest.mark.parametrize("drop", [None, 3])
def test_word_counts(odd, none, drop):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    found = {r["word"]: r["n"] for r in word_counts(odd, drop_one_in=drop).collect()}
    assert found == dict(plain_counts(rows, drop))
    assert word_counts(none, drop_one_in=drop).collect() == []


def test_counts_that_are_handed_on_early_add_up(odd, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD_WORDS", 3)
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert {r["word"]: r["n"] for r in word_counts(odd).collect()} == dict(plain_counts(rows))


def test_given_table(documents, texts):
    found = rows_of(spelling_variants(word_counts(documents, drop_one_in=199)))
    counts = {w: n for w, n in plain_counts(texts.items(), 199).items() if n >= 5}
    by_length = Counter(map(len, counts))
    assert by_length and found == by_definition(counts)
