"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Hashed features of each n-gram length, and the lengths.
BITS, LENGTHS = 14, (1, 2, 3)
FEATURES = len(LENGTHS) << BITS
SMOOTHING = 0.5
#: The bit weights are measured on about so many labelled rows at most; the n-gram counts on all.
CALIBRATION_ROWS = 20_000
#: Languages up to this number get every split into two as a bit.
EXHAUSTIVE = 5
AMBIGUOUS = 0.1
_SHORT = 20


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), dtype=bool, count=1 << 16)


def features(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of the text's letters and their counts; None where there is no letter.

    Letters in lower case; every run of other characters is one space.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    high = points >= len(letters)
    is_letter = letters[np.where(high, 0, points)]
    for k in np.flatnonzero(high):
        is_letter[k] = chr(points[k]).isalpha()
    if not is_letter.any():
        return None
    points = np.where(is_letter, points, 32)
    points = points[is_letter | np.append(True, is_letter[:-1])].astype(np.uint64)
    points = np.concatenate([[np.uint64(32)], points, [np.uint64(32)]])
    counts = np.zeros(FEATURES, dtype=np.int64)
    gram = np.zeros(len(points), dtype=np.uint64)
    for k, length in enumerate(LENGTHS):
        gram = gram[: len(points) - length + 1] * np.uint64(0x100000001B3) + points[length - 1 :]
        slot = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        counts[k << BITS : (k + 1) << BITS] = np.bincount(slot.astype(np.int64), minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language.

    All splits into two for few languages; for many, the draw (of 64, seeded)
    whose closest rows are farthest apart, with ten bits per doubling.
    """
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE:
        splits = [[1] + [1 if s >> k & 1 else -1 for k in range(languages - 1)] for s in range(2 ** (languages - 1) - 1)]
        return np.array(splits, dtype=float).T
    width, rng, best, far = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(5), None, -1.0
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], size=(languages, width))
        mixed = np.abs(code.sum(axis=0)) < languages
        code = code[:, mixed]
        apart = (code.shape[1] - code @ code.T) / 2
        least = (apart + np.eye(languages) * width).min()
        if least > far:
            best, far = code, least
    return best


@dataclass
class LanguageModel:
    """Binary n-gram classifiers, one per bit of the codewords, and the bits' weights by language."""

    languages: list[str]
    code: np.ndarray
    classifiers: np.ndarray  # features x bits: log odds
    scales: np.ndarray  # of the bits' margins
    trust: np.ndarray  # languages x bits, rows sum to 1

    def parts(self) -> tuple:
        """What the model is made of, as plain values that travel without this module."""
        return self.languages, self.code, self.classifiers, self.scales, self.trust

    def margins(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean log odds of each bit, over the scale of that bit, smaller for a few n-grams."""
        n = counts.sum()
        return (counts @ self.classifiers[found]) / (n + _SHORT) / self.scales

    def decode(self, margins: np.ndarray) -> tuple[int, float, bool]:
        """The nearest codeword by weighted logistic loss, its likeness, and whether the next is as near."""
        loss = (self.trust * np.logaddexp(0, -3 * self.code * margins)).sum(axis=1) * self.code.shape[1]
        odds = np.exp(loss.min() - loss)
        odds /= odds.sum()
        best = int(odds.argmax())
        second = np.partition(odds, -2)[-2] if len(odds) > 1 else 0.0
        return best, float(odds[best]), bool(odds[best] - second < AMBIGUOUS)


def _counted(documents: DataFrame) -> DataFrame:
    """Sums of n-gram counts over all rows of ``text, lang``: ``lang, feature, n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = _letters(), {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if (grams := features(text, letters)) is not None:
                    held = sums.setdefault(lang, np.zeros(FEATURES, dtype=np.int64))
                    held[grams[0]] += grams[1]
        for lang, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at])],
                ["lang", "feature", "n"],
            )

    return documents.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(
        F.sum("n").alias("n")
    )


def _calibrated(sample: DataFrame, model: LanguageModel) -> DataFrame:
    """Per language and bit of the sample: rows, rows on the right side, and the sum of sizes of the margins."""
    held = sample.sparkSession.sparkContext.broadcast(model.parts())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = LanguageModel(*held.value), _letters()
        place = {lang: k for k, lang in enumerate(model.languages)}
        right, size = np.zeros(model.code.shape), np.zeros(model.code.shape)
        rows = np.zeros(len(model.languages))
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if (grams := features(text, letters)) is not None and lang in place:
                    margins, k = model.margins(*grams), place[lang]
                    rows[k] += 1
                    right[k] += margins * model.code[k] > 0
                    size[k] += np.abs(margins)
        k, b = np.nonzero(np.repeat(rows[:, None] > 0, model.code.shape[1], axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(k), pa.array(b), pa.array(rows[k]), pa.array(right[k, b]), pa.array(size[k, b])],
            ["language", "bit", "n", "right", "size"],
        )

    found = sample.mapInArrow(measure, "language long, bit long, n double, right double, size double")
    return found.groupBy("language", "bit").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("size").alias("size"))


def train(documents: DataFrame, text_column: str = "text", lang_column: str = "lang",
          calibration_rows: int = CALIBRATION_ROWS) -> LanguageModel:
    """Fit the classifiers on all rows with a text and a language.

    Each bit's classifier is the log odds of hashed n-grams between the
    languages on its two sides, from counts over all rows; the driver sees at
    most ``FEATURES`` sums per language. The bits' weights, each language's
    share of rows on the right side, come from about ``calibration_rows`` rows
    chosen by the hash of their text.
    """
    labelled = documents.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")
    )
    table = _counted(labelled).toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    place = {lang: k for k, lang in enumerate(names)}
    counts = np.zeros((len(names), FEATURES))
    rows = np.array([place[x] for x in table.column("lang").to_pylist()], dtype=int)
    counts[rows, table.column("feature").to_numpy()] = table.column("n").to_numpy()
    code = codewords(len(names))
    bits = code.shape[1]
    classifiers = np.zeros((FEATURES, bits))
    # Languages weigh alike, however many rows they have.
    shares = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    floor = SMOOTHING / np.maximum(1, counts.sum(axis=1)).min() if len(names) else 1.0
    for b in range(bits):
        on, off = shares[code[:, b] > 0], shares[code[:, b] < 0]
        if len(on) and len(off):
            classifiers[:, b] = np.log(on.mean(axis=0) + floor) - np.log(off.mean(axis=0) + floor)
    model = LanguageModel(names, code, classifiers, np.ones(bits), np.full(code.shape, 1 / bits))
    if len(names) > 1:
        chosen = labelled.where(_sampled(labelled.count(), calibration_rows))
        right, size, seen = np.zeros(code.shape), np.zeros(bits), np.zeros(bits)
        for r in _calibrated(chosen, model).collect():
            right[r["language"], r["bit"]] = r["right"] / r["n"]
            size[r["bit"]] += r["size"]
            seen[r["bit"]] += r["n"]
        model.scales = np.where(seen > 0, size / np.maximum(1, seen), 1.0) + 1e-12
        trust = np.maximum(right, 0.01)
        model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def _sampled(n: int, wanted: int) -> Column:
    """Whether a row is among about ``wanted`` of ``n``, by 62 bits of its text's hash, so that the share may be ever so small."""
    limit = 2**62 if n <= wanted else max(1, 2**62 * wanted // n)
    return F.pmod(F.xxhash64("text"), F.lit(2**62)) < F.lit(limit)


def identify(documents: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, lang_pred, score, ambiguous`` of each row, from its whole text alone.

    Null texts and texts without letters, and all texts if no language was
    learned, get ``und`` with score 0. A row per row given; no rows give no
    rows; other columns are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast(model.parts())
    kind = documents.schema[id_column].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = LanguageModel(*held.value), _letters()
        for batch in batches:
            names, scores, flags = [], [], []
            for text in batch.column(1).to_pylist():
                grams = features(text, letters) if text and model.languages else None
                best, score, flag = model.decode(model.margins(*grams)) if grams else (None, 0.0, True)
                names.append(UNKNOWN if best is None else model.languages[best])
                scores.append(score)
                flags.append(flag)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags)],
                ["id", "lang_pred", "score", "ambiguous"],
            )

    chosen = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(predict, f"id {kind}, lang_pred string, score double, ambiguous boolean")


def held_out(id_column: str | Column = "doc_id") -> Column:
    """Whether a document is kept from training: the remainder of its id's checksum by 4 is 2."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))
