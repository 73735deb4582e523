"""Fingerprints: equal texts, likeness, and the chain of documents against a plain loop."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm.imatch import Fingerprinter, edited_texts, fingerprints, lexicon, likeness, terms


def test_lexicon_is_the_band_of_document_frequencies(spark):
    rows = [(k, "Common " + ("middle " if k % 4 == 0 else "") + f"rare{k}") for k in range(100)]
    found = lexicon(spark.createDataFrame(rows, "doc_id long, text string"), min_share=0.05, max_share=0.5)
    expected = Fingerprinter(found).hashes.of([b"middle"])
    assert found.tolist() == expected.tolist()


def test_terms_are_distinct_lower_case_and_part_at_signs():
    assert terms("A,b a;B É".encode()) == {b"a", b"b", "É".encode()}


def test_fingerprint_by_plain_sets():
    words = [f"w{k}".encode() for k in range(300)]
    maker = Fingerprinter(np.sort(Fingerprinter(np.zeros(0, "u8")).hashes.of(words[:200])), families=16)
    one, two = maker.of(b" ".join(words)), maker.of(b" ".join(reversed(words)) + b" w1 unknown")
    assert (one == two).all() and likeness(one, two) == 1.0  # order, repeats and unknown words do not count
    half = maker.of(b" ".join(words[:100]))
    assert 0.2 < likeness(maker.of(b" ".join(words[:200])), half) < 0.9
    # Each family's lexicon is the smallest power of two above its least rank, by plain numbers.
    found = [int(t) for t in maker.hashes.of(words[:200])]
    for f, (factor, shift) in enumerate(zip(maker.factors, maker.shifts)):
        ranks = [(t * int(factor) + int(shift)) % 2**64 for t in found]
        bits = min(ranks).bit_length()
        inside = {t for t, r in zip(found, ranks) if r < 2**bits}
        again = maker.of(b" ".join(w for w, t in zip(words, found) if t in inside))
        assert again[f + 1] == maker.of(b" ".join(words[:200]))[f + 1]


def test_edited_texts_by_a_loop(documents, texts):
    found = {r["id"]: r for r in edited_texts(documents, lexicon(documents)).collect()}
    ids = sorted(texts)
    assert sorted(found) == ids
    near, far = [], []
    for k, i in enumerate(ids):
        own, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        row = found[i]
        assert row["n_chars"] == len(own)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        near.append(row["near_edited"])
        far.append(row["near_next"])
        assert (row["fingerprint"] == found[ids[(k + 1) % len(ids)]]["fingerprint"]) == (row["near_next"] == 1)
    assert np.mean(near) > 0.2 and np.mean(far) < 0.05


def test_odd_rows(odd, none):
    found = edited_texts(odd, lexicon(odd)).collect()
    assert len(found) == odd.count()
    rows = {}
    for r in found:
        rows.setdefault(r["id"], []).append(r)
    assert len(rows[6]) == 2 and rows[5][0]["fingerprint"] == rows[6][0]["fingerprint"]
    assert rows[1][0]["fingerprint"] == rows[2][0]["fingerprint"] == rows[3][0]["fingerprint"]
    assert rows[1][0]["n_chars"] == 0 and rows[1][0]["near_next"] == 1.0
    # The row without id is the last, before the first, whose text is empty.
    own = "a row without id\nsame line"
    half = own[: len(own) - len(own) // 2]
    assert rows[None][0]["edited_sha256"] == hashlib.sha256(half.encode()).hexdigest()
    no_ids = odd.where("doc_id IS NULL OR doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))
    assert edited_texts(no_ids, lexicon(no_ids)).count() == 2
    assert edited_texts(none, lexicon(none)).count() == 0
    assert fingerprints(none, lexicon(none)).count() == 0
    alone = odd.where("doc_id = 5")
    assert edited_texts(alone, lexicon(alone)).first()["near_next"] == 1.0
