"""Packing: ids by the tokenizer, gapless sequences, and how few they are."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quernstone.llm.packing import _tokenizer, best_fit, fit_counts, length_patterns, pack_documents, plan_sequences, slots

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é  \n\t.'12　ß\U0001f600<|>s"), max_size=40))
def test_chunks_give_the_tokenizers_ids(text):
    assert np.frombuffer(IDS(text), "<u4").tolist() == ids_of(text)


IDS = _tokenizer("byte_bpe_50k")


def test_special_names_are_the_tokenizers():
    text = "a <|endoftext|> b  c"
    assert np.frombuffer(IDS(text), "<u4").tolist() == ids_of(text)


def check(rows, texts, most=1024):
    """Pieces cover each document; sequences are gapless and no longer than allowed. Returns their number."""
    by_id, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_id[r["id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_id) == set(texts)
    for i, pieces in by_id.items():
        ids = ids_of(texts[i]) + [2]
        pieces.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(pieces):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part))
            assert r["length"] == most or k == 0
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= most
    return len(by_sequence)


def test_documents(documents, texts):
    rows = pack_documents(documents).collect()
    count = check(rows, texts)
    assert count <= -(-sum(r["length"] for r in rows) // 1024) + 3


def test_odd_rows(odd, none):
    plain = odd.where("doc_id IS NOT NULL AND doc_id <> 6")
    check(pack_documents(plain).collect(), {r["doc_id"]: r["text"] for r in plain.collect()})
    rows = pack_documents(odd).collect()
    assert [r["length"] for r in rows if r["id"] in (1, 2)] == [1, 1]
    assert len([r for r in rows if r["id"] == 6]) == 2 and len([r for r in rows if r["id"] is None]) == 1
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (s, o, n), (t, p, _) in zip(places, places[1:]):
        assert p == (o + n if s == t else 0)
    assert pack_documents(none).count() == 0


def held(plan, most):
    out = np.zeros(most + 1, dtype=int)
    for times, *lengths in plan:
        assert times > 0 and sum(lengths) <= most
        for length in lengths:
            out[length] += times
    return out


def test_plans_hold_the_histogram():
    rng = random.Random(3)
    for most in (8, 64, 200):
        for _ in range(20):
            histogram = np.zeros(most + 1, dtype=int)
            for _ in range(rng.randint(0, 60)):
                histogram[rng.randint(1, most)] += rng.randint(1, 30)
            plan = plan_sequences(histogram, most, step=3)
            assert (held(plan, most) == histogram).all()
            assert (held(best_fit(histogram, most), most) == histogram).all()
            table = slots(plan)
            assert len(table) == sum(len(p) - 1 for p in plan)


def test_least_squares_fit_a_mixture_of_patterns():
    patterns = length_patterns(60, 1)
    assert (patterns.sum(axis=1) == 60).all()
    rng = np.random.default_rng(2)
    histogram = np.zeros(61, dtype=int)
    for k in rng.choice(np.arange(1, len(patterns)), 12, replace=False):
        for length in patterns[k]:
            histogram[length] += 50
    histogram[0] = 0
    counts = fit_counts(patterns, histogram, rounds=3000)
    fitted = sum(np.bincount(patterns[:, k], weights=counts, minlength=61) for k in range(3))
    assert (counts >= 0).all() and np.abs(fitted[1:] - histogram[1:]).max() < 2
    plan = plan_sequences(histogram, 60, step=1)
    assert sum(p[0] for p in plan) <= 1.02 * (np.arange(61) @ histogram) / 60
