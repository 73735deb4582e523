"""Language identification: codewords, decoding, and accuracy on documents not learned from."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm.languages import LanguageModel, codewords, held_out, identify, train


@pytest.mark.parametrize("n", (2, 3, 4, 5, 9, 30))
def test_codewords_are_apart(n):
    code = codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
    assert all(len(set(code[:, b])) == 2 for b in range(code.shape[1]))
    apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert min(apart) >= max(1, code.shape[1] // 4)


def test_decoding_mends_a_wrong_bit():
    code = codewords(4)
    bits = code.shape[1]
    model = LanguageModel(list("abcd"), code, np.zeros((1, bits)), np.ones(bits), np.full(code.shape, 1 / bits))
    for k in range(4):
        margins = code[k].copy()
        assert model.decode(margins)[0] == k and not model.decode(margins)[2]
        margins[k] *= -1
        assert model.decode(margins)[0] == k
    assert model.decode(np.zeros(bits))[2]  # nothing known: ambiguous


def test_trust_counts():
    """A bit that is no good for any language does not decide."""
    code = codewords(3)
    model = LanguageModel(list("abc"), code, np.zeros((1, 3)), np.ones(3), np.array([[0.49, 0.49, 0.02]] * 3))
    margins = np.array([code[1][0], code[1][1], -5 * code[1][2]])
    assert model.decode(margins)[0] == 1


def test_held_out_accuracy(spark, documents):
    larger = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(larger.where(~held_out()))
    found = identify(larger, model).join(larger.select(F.col("doc_id").alias("id"), "lang", held_out().alias("out")), "id")
    rows = found.where("out").collect()
    assert all(zlib.crc32(str(r["id"]).encode()) % 4 == 2 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows) and len(rows) > 200
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(odd, none):
    model = train(odd)
    assert model.languages == ["de", "en", "es", "fr"]
    rows = {}
    for r in identify(odd, model).collect():
        rows.setdefault(r["id"], []).append((r["lang_pred"], r["score"], r["ambiguous"]))
    for k in (1, 2, 3, 4):
        assert rows[k] == [("und", 0.0, True)]
    assert rows[5][0] == rows[6][0] == rows[6][1] and sum(map(len, rows.values())) == odd.count()
    untaught = train(none)
    assert untaught.languages == [] and {r["lang_pred"] for r in identify(odd, untaught).collect()} == {"und"}
    assert identify(none, model).count() == 0
    single = train(odd.where("lang = 'es'"))
    assert identify(odd.where("doc_id = 5"), single).first()["lang_pred"] == "es"
    assert not odd.where("doc_id IS NULL").select(held_out()).first()[0]


def test_calibration_sample_does_not_run_dry(spark):
    """About as many rows as are wanted, for pretended row counts of any size."""
    from quernstone.llm.languages import _sampled

    texts = spark.range(200_000).select(F.concat(F.lit("text "), "id").alias("text"))
    assert texts.where(_sampled(10, 20)).count() == 200_000
    assert 1_500 < texts.where(_sampled(2_000_000, 20_000)).count() < 2_500
    # Of 10**14 rows 20,000 are wanted: a share far below a millionth still lets rows in.
    assert str(2**62 * 20_000 // 10**14) in str(_sampled(10**14, 20_000))
