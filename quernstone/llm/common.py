"""What several operators share: stored steps, word rules, hashes and plain texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
_CACHE_WORDS = 400_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder once and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_text(column: str | Column) -> Column:
    """A text column without nulls."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def words_of(text: Column) -> Column:
    """The runs of other characters than ``SPACES``, in order."""
    return F.array_remove(F.split(text, SPACES), "")


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, each worked out once while it is held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words; of the whole sequence, as one, where it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
