"""BPE ids against the tokenizers library, and round trips."""

import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from quernstone.llm.bpe import VOCABULARY, ByteBpe, decode_documents, encode_documents, vocabulary_of  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


@pytest.fixture(scope="module")
def bpe():
    return vocabulary_of(VOCABULARY)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def by_library(library, texts):
    return [packed(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def made_up(seed, n):
    draw = random.Random(seed)
    parts = [
        "a", "aa", "th", "ing", "e", " ", "  ", "\n", "\t ", "é", "ß", "日本", "\U0001f600", "12", "'s", "'ll", "!", "...",
        "<|endoftext|>", "<|endof", "\x1c", " ", "­", "Ġ", "tion", "and", "՘", "’", "x" * 70,
    ]
    mixed = ["".join(draw.choice(parts) for _ in range(draw.randrange(50))) for _ in range(n)]
    letters = ["".join(chr(draw.randrange(97, 123)) for _ in range(draw.randrange(120))) for _ in range(n)]
    few = ["".join(draw.choice("ab ") for _ in range(150)) for _ in range(n // 10)]
    return mixed + letters + few + ["a" * k for k in range(200)] + ["", " ", "\n \n"]


def test_ids_are_the_librarys(bpe, library):
    texts = made_up(1, 3000)
    assert list(bpe.encode(texts)) == by_library(library, texts)


def test_ids_of_random_code_points(bpe, library):
    draw = random.Random(2)
    points = [c for c in (draw.randrange(1, 0x110000) for _ in range(30_000)) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[k : k + 10])) for k in range(0, len(points), 10)]
    assert list(bpe.encode(texts)) == by_library(library, texts)


def test_long_texts_and_long_words_pass_in_blocks(bpe, library, monkeypatch):
    monkeypatch.setattr("quernstone.llm.bpe.BLOCK_WORDS", 50)
    monkeypatch.setattr("quernstone.llm.bpe.BLOCK_CHARS", 100)
    monkeypatch.setattr("quernstone.llm.bpe.HELD_WORDS", 40)
    texts = ["", "x" * 5000, "many words " * 400, "tabs \t and spaces  " * 300, "end"] + made_up(3, 200)
    assert list(ByteBpe(public_tokenizers.path(VOCABULARY)).encode(texts)) == by_library(library, texts)


def test_a_speculation_that_fails_is_merged_exactly(bpe, library):
    draw = random.Random(4)
    words = [("".join(draw.choice("etaoinshr") for _ in range(draw.randrange(1, 14)))).encode() for _ in range(4000)]
    ids, failed = bpe.resolve(words)
    assert 0 < failed < len(words)
    assert ids == by_library(library, [w.decode() for w in words])
    wrong = sum(packed(bpe.propose(w)) != i for w, i in zip(words, ids))
    # Whatever passes the check of its pairs is right, and whatever fails it was wrong.
    assert wrong == failed
    assert [packed(bpe.merge(w)) for w in words] == ids


def test_decoding_is_the_librarys(bpe, library):
    draw = random.Random(5)
    ids = [[draw.randrange(50257) for _ in range(12)] for _ in range(3000)]
    assert [bpe.decode(packed(i)) for i in ids] == library.decode_batch(ids, skip_special_tokens=False)
    assert bpe.decode(packed([15496, 4_000_000])) == "Hello"


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_odd_rows(odd, library):
    encoded = encode_documents(odd)
    rows = decode_documents(encoded).collect()
    given = odd.select("doc_id", "text").collect()
    assert len(rows) == len(given)
    wanted = sorted(((r["doc_id"] or -1, r["text"] or "") for r in given))
    assert sorted((r["id"] or -1, r["decoded"]) for r in rows) == wanted
    for r in rows:
        assert bytes(r["ids"]) == by_library(library, [r["decoded"]])[0] and r["n_tokens"] == len(r["ids"]) // 4


def test_no_rows(none):
    assert decode_documents(encode_documents(none)).collect() == []


def test_whole_table_round_trips(documents, texts, library):
    rows = decode_documents(encode_documents(documents)).collect()
    assert {r["id"]: r["decoded"] for r in rows} == texts
    ids = dict(zip(texts, by_library(library, list(texts.values()))))
    assert {r["id"]: bytes(r["ids"]) for r in rows} == ids
