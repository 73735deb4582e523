"""Periodic runs against a search by definition."""

import random
import zlib

import pytest
from conftest import words_of
from quernstone.llm.periodic_runs import (
    collapsed, longest_by_exponent, periodic_runs, runs_of_texts, scan_lags, split_rare,
)
from quernstone.llm.word_queries import QUERIES, with_planted_runs
from pyspark.sql import functions as F


def by_definition(words, least_words=6, least_periods=4):
    out = set()
    for q in range(1, len(words) // least_periods + 1):
        k = 0
        while k + q < len(words):
            end = k
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end - k + q
            if end > k and length >= max(least_words, least_periods * q):
                stretch = words[k : k + length]
                if not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                    out.add((k, length, q))
            k = max(end, k + 1)
    return sorted(out)


def made_up(seed, n):
    draw = random.Random(seed)
    for _ in range(n):
        letters = [bytes([97 + x]) for x in range(draw.choice([1, 2, 3, 6]))]
        words = []
        while len(words) < draw.randrange(80):
            part = [draw.choice(letters) for _ in range(draw.randrange(1, 7))]
            words += part * draw.choice([1, 1, 2, 5, 9])
        yield words


@pytest.mark.parametrize("least_words, least_periods", [(6, 4), (2, 2), (10, 3)])
def test_runs_are_those_of_the_definition(least_words, least_periods):
    texts = list(made_up(1, 1500))
    found = runs_of_texts(texts, least_words, least_periods)
    assert found == [by_definition(t, least_words, least_periods) for t in texts]
    assert sum(map(len, found)) > 500


def test_rare_words_split_until_nothing_splits():
    import numpy as np

    # 9 parts the text; then 1 is too rare in both halves, and what is left of the second is too short.
    words = np.array([0] * 8 + [1, 1] + [0] * 6 + [9] + [1, 1] + [0] * 5)
    assert split_rare(words, np.zeros(len(words), int), 4, 6) == [(0, 8), (10, 16)]
    assert split_rare(np.array([], int), np.array([], int), 4, 6) == []


def test_long_segments_do_not_take_a_scan_per_lag():
    import numpy as np

    assert scan_lags(np.zeros(60_000, int), 6, 4) == [(0, 60_000, 1)]
    assert scan_lags(np.arange(60_000) % 11, 6, 4) == [(0, 60_000, 11)]


def test_collapsed_keeps_the_first_period():
    words = [b"x", *[b"a", b"b"] * 4, b"y"]
    assert collapsed(words, by_definition(words)) == b"x a b y"
    assert collapsed([], []) == b""


def test_odd_rows(odd):
    rows = periodic_runs(odd).collect()
    given = odd.select("doc_id", "text").collect()
    key = lambda i, n, runs, text: (i or -1, n, runs, text)
    wanted = []
    for r in given:
        words = [w.encode() for w in words_of(r["text"])]
        runs = [] if len(words) > 5000 else by_definition(words)
        wanted.append(key(r["doc_id"], len(words), runs, collapsed(words, runs).decode()))
    found = [key(r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows]
    assert sorted(found) == sorted(wanted)
    assert any(r["runs"] for r in rows)


def test_no_rows(none):
    assert periodic_runs(none).collect() == []


def test_longest_by_exponent(spark):
    run = lambda *r: dict(zip(("start", "length", "period"), r))
    rows = [
        (1, [run(0, 8, 2), run(10, 40, 10), run(60, 9, 2)]),
        (2, [run(5, 8, 2), run(9, 4, 1)]),  # equal: the first
        (3, []),
        (4, [run(0, 2**40 + 1, 2**20), run(2**41, 2**40 + 2, 2**20)]),
    ]
    df = spark.createDataFrame(rows, "id int, runs array<struct<start:long,length:long,period:long>>")
    best = {r["id"]: r["best"] for r in df.select("id", longest_by_exponent(F.col("runs")).alias("best")).collect()}
    assert [best[k] and best[k]["start"] for k in (1, 2, 3, 4)] == [60, 5, None, 2**41]


def test_planted_runs(odd, spark):
    rows = {r["doc_id"]: r["text"] for r in with_planted_runs(odd).where("doc_id <> 6").collect()}
    given = {r["doc_id"]: r["text"] for r in odd.select("doc_id", "text").collect()}
    changed = 0
    for key, text in given.items():
        if key is None or key == 6:
            continue
        h, words = zlib.crc32(str(key).encode()), words_of(text)
        if h % 10 or not words:
            assert rows[key] == text
            continue
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert rows[key].split(" ") == [words[i if i < a else a + (i - a) % p] for i in range(n)]
        changed += 1
    assert changed


def test_query(documents, spark):
    from conftest import SF_DIR

    rows = QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()
    assert len(rows) == documents.count() and sum(r["n_runs"] for r in rows) > 10
