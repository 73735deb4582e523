"""The similarity join against all pairs."""

import itertools
import random

import numpy as np
import pytest
from conftest import LOWER, words_of

from quernstone.llm import ngram_join
from quernstone.llm.bucket_links import linked
from quernstone.llm.components import components
from quernstone.llm.ngram_join import one_of_each, shared_tokens, similar_documents

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    words = words_of((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2)))


def brute(rows, percent=90):
    """The smallest id reachable, by all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        one, two = sets[a], sets[b]
        if one and two and 100 * len(one & two) >= percent * len(one | two):
            x, y = root(a), root(b)
            least[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def got(df):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_documents(documents, texts):
    expected = brute(texts.items())
    assert got(similar_documents(documents)) == expected
    kept = one_of_each(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)


def edits(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.getrandbits(20)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", range(3))
def test_groups_near_the_limit(spark, seed):
    """Chains of edits about as many as the limit bears, in sizes from a few words to many."""
    rng = random.Random(seed)
    rows = []
    for size in (1, 2, 3, 5, 12, 30, 60, 200, 400):
        words = [f"w{rng.randrange(300)}" for _ in range(size)]
        for _ in range(8):
            rows.append((len(rows), " ".join(words)))
            words = edits(rng, words, rng.randint(0, max(1, size // 55))).split()
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    expected = brute(rows)
    assert 5 < len({c for _, c in expected.values()}) < len(rows)
    assert got(similar_documents(spark.createDataFrame(rows, SCHEMA))) == expected


def test_a_large_group_is_not_paired(spark, monkeypatch):
    """Four hundred near copies, and as many that share a part: verified pairs grow with their number."""
    rng = random.Random(9)
    base, part = [f"b{k}" for k in range(150)], [f"p{k}" for k in range(40)]
    rows = [(k, edits(rng, base, 1)) for k in range(400)]
    rows += [(1000 + k, " ".join(part + [f"u{k}x{j}" for j in range(60)])) for k in range(200)]
    verified = []

    def counting(postings, verify, percent):
        def counted(pairs):
            verified.append(pairs.count())
            return verify(pairs)

        return linked(postings, counted, percent)

    monkeypatch.setattr(ngram_join, "linked", counting)
    found = got(similar_documents(spark.createDataFrame(rows, SCHEMA)))
    assert {found[k][1] for k in range(400)} == {0}
    assert all(found[1000 + k][1] == 1000 + k for k in range(200))
    assert sum(verified) < 8 * len(rows)


def test_prefixes_lengthen_when_that_is_cheap():
    rare_then_common = np.array([1, 1, 1, 500, 500, 500])
    assert shared_tokens(20, 0, rare_then_common, 90) == 1
    assert shared_tokens(20, 0, np.full(20, 50), 90) > 1
    assert shared_tokens(1, 0, np.array([9]), 90) == 1


def test_components_of_chains_and_hubs(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (201, 200)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {found[k] for k in range(1, 41)} == {1} and {found[k] for k in range(100, 160)} == {100}
    assert found[201] == found[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none):
    rows = {}
    for r in similar_documents(odd).collect():
        rows.setdefault(r["id"], []).append((r["n_shingles"], r["component_id"]))
    assert rows[1] == [(0, 1)] and rows[2] == [(0, 2)] and rows[3] == [(0, 3)]
    assert rows[5][0][1] == rows[6][0][1] == rows[6][1][1] == 5 and rows[12] == [(1, 12)]
    assert rows[None][0][1] is None and sum(map(len, rows.values())) == odd.count()
    assert one_of_each(odd).count() == odd.count() - 2
    assert similar_documents(none).count() == 0 and one_of_each(none).count() == 0
