"""Documents with everything odd in them, and a plain table of the test data."""

import os
import re

import pytest

SF_DIR = "/root/testdata/sf0.001"
SPACES = r"[\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns carry names that operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, word string, words string, "
    "line int, host string, label string, bucket int, h string, size long, component string, k1 long, unit string"
)
EXTRA = (7, "w", "ws", 1, "h", "l", 2, "x", 3, "c", 4, "u")


def words_of(text):
    return [w for w in re.split(SPACES, text or "") if w]


def odd_rows():
    long = " ".join(f"word{k % 977} thing{k}" for k in range(60_000))
    prose = "The quick brown fox jumps over the lazy dog while nine other foxes watch it from the hill nearby today."
    other = "Many small boats drift along the quiet river until the evening bells call all of them home again at last."
    texts = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, "   \t \n ", None, "a"),
        (4, "1234 !!! ???", "en", None),
        (5, prose, "en", "b"),
        (6, prose, "en", "b"),
        (6, prose, "en", "b"),  # a repeated row
        (7, prose + "\n" + other, "fr", None),
        (8, other + "\nUnder the MIT License. CC BY-NC", None, "b"),
        (9, long, "en", "b"),
        (10, "Über ß É ñ \U0001f600 naïve", "de", "c"),
        (11, "\n".join(["same line"] * 40), "de", "c"),
        (12, "one", "de", "c"),
        (None, "a row without id\nsame line", "fr", "c"),
    ]
    rows = [(i, t, lang, src, None if t is None else len(t), *EXTRA) for i, t, lang, src in texts]
    # One line that ten documents share.
    rows += [(20 + k, f"body number {k}\n A Shared line \nend {k}", "es", "d", 9, *EXTRA) for k in range(10)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
