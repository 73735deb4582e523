"""Mixing: water-filling against a loop, and what is taken against the targets."""

import hashlib
from collections import Counter, defaultdict

import pytest
import xxhash
from conftest import words_of
from pyspark.sql import functions as F

from quernstone.llm.mixing import fill_targets, mix_sources, mixed_documents


def fill(sizes, weights, epochs):
    """Clamp what is above its limit, share the excess, until none is."""
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        open_ = {s: w for s, w in weights.items() if s not in capped}
        shares = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = {s: epochs * sizes[s] for s in open_ if shares[s] > epochs * sizes[s] + 1e-9}
        if not over:
            return shares | capped
        capped |= over


def plain_repeats(rows, weights=(5, 2, 1), epochs=3, seed=7):
    """Counter of ``(id, text, source)``: how often each different row (id, text, source) is taken."""
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[2]].append(row)
    order = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
    size = lambda row: len(words_of(row[1]))
    sizes = {s: sum(map(size, by_source[s])) for s in order}
    targets = fill(sizes, {s: weights[k % len(weights)] for k, s in enumerate(order)}, epochs)

    def place(row):
        text = f"{xxhash.xxh64_intdigest((row[1] or '').encode(), seed=42):X}"
        name = str(row[0]) if row[0] is not None else f":{text}"
        return hashlib.md5(f"{seed}:{name}".encode()).hexdigest() + ":" + text

    out = Counter()
    for source in order:
        whole = int(targets[source] // sizes[source]) if sizes[source] else 0
        wanted, before, groups = targets[source] - whole * sizes[source], 0, defaultdict(list)
        for row in by_source[source]:
            groups[place(row)].append(row)
        for key in sorted(groups):
            n = sum(map(size, groups[key]))
            more = wanted > 0 and 2 * before + n <= 2 * wanted
            before += n
            for row in groups[key]:
                out[row] = max(out[row], whole + more)
    return out


CASES = [
    {"a": 100, "b": 100, "c": 100},
    {"a": 1, "b": 1000, "c": 5, "d": 30, None: 4},
    {"a": 0, "b": 7, "c": 0},
    {"a": 10},
    {f"s{k:02d}": (k * k * 37) % 101 for k in range(25)},
]


@pytest.mark.parametrize("sizes", CASES)
def test_water_filling_by_a_loop(spark, sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    df = spark.createDataFrame([(s, sizes[s], weights[s]) for s in order], "source string, source_size long, weight long")
    found = {r["source"]: r["target"] for r in fill_targets(df, 3).collect()}
    expected = fill(sizes, weights, 3)
    assert set(found) == set(expected)
    for s in found:
        assert found[s] == pytest.approx(expected[s])
    assert sum(found.values()) == pytest.approx(sum(sizes.values()))


def test_documents(documents):
    rows = mix_sources(documents).collect()
    given = {r["doc_id"]: r for r in documents.collect()}
    assert sorted(r["id"] for r in rows) == sorted(given)
    taken, targets, largest = Counter(), {}, defaultdict(int)
    for r in rows:
        assert r["size"] == len(words_of(given[r["id"]]["text"])) and r["source"] == given[r["id"]]["source"]
        assert r["taken"] == r["size"] * r["repeats"] and r["repeats"] <= 3
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1
    again = {r["id"]: r["taken"] for r in mix_sources(documents.repartition(7)).collect()}
    assert again == {r["id"]: r["taken"] for r in rows}
    other = {r["id"]: r["taken"] for r in mix_sources(documents, seed=8).collect()}
    assert other != again
    copies = Counter(r["doc_id"] for r in mixed_documents(documents).collect())
    assert copies == Counter({r["id"]: r["repeats"] for r in rows if r["repeats"]})


def test_taken_rows_are_those_of_the_loop(documents, odd):
    for df in (documents, odd):
        found = {(r["id"], r["source"], r["size"]): r["repeats"] for r in mix_sources(df).collect()}
        plain = plain_repeats([(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()])
        assert found == {(i, s, len(words_of(t))): n for (i, t, s), n in plain.items()}


def test_odd_rows(odd, none):
    rows = mix_sources(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and (r["size"] > 0 or r["taken"] == 0)
    assert {r["source"] for r in rows} == {"a", "b", "c", "d", None}
    assert {r["target"] for r in rows if r["source"] == "a"} == {0.0}
    assert mix_sources(none).count() == 0
    mixed = mixed_documents(odd.where("doc_id <> 6"))
    assert mixed.columns == odd.columns and mixedless(none)


def mixedless(none):
    return mixed_documents(none).count() == 0


def test_odd_rows_are_taken_as_counted(odd):
    """Rows without id and repeated rows are in the mix as often as ``mix_sources`` says, each with its own columns."""
    rows = odd.unionByName(odd.where("doc_id IN (5, 7, 10)").withColumn("doc_id", F.lit(None).cast("long")))
    counted = Counter()
    for r in mix_sources(rows).collect():
        counted[r["id"], r["source"], r["size"]] += r["repeats"]
    assert sum(n for (i, _, _), n in counted.items() if i is None) > 0
    found, given = Counter(), {tuple(r) for r in rows.collect()}
    for r in mixed_documents(rows).collect():
        assert tuple(r) in given
        found[r["doc_id"], r["source"], len(words_of(r["text"]))] += 1
    assert found == +counted
