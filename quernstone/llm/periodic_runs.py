"""Periodic runs of words: recursive splitting at rare words, then a scan of lags within what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, plain_text

#: A run holds at least so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of texts that are split together.
BLOCK_WORDS = 1_000_000
RUN = "struct<start:long,length:long,period:long>"


def split_rare(words: np.ndarray, segments: np.ndarray, least: int, shortest: int) -> list[tuple[int, int]]:
    """The stretches of ``words`` in which every word occurs ``least`` times or more, as (start, end).

    ``segments`` numbers the stretches to begin with (texts). Each round counts
    words by segment; those that are too rare split their segment, and rounds
    go on within what is left until nothing splits. Stretches of fewer than
    ``shortest`` words are given up at once.
    """
    places = np.arange(len(words))
    while len(places):
        # The order of (segment, word) pairs gives their counts.
        key = segments.astype(np.int64) * (int(words.max()) + 1) + words
        _, pair, counts = np.unique(key, return_inverse=True, return_counts=True)
        keep = counts[pair] >= least
        # Neighbours in one segment stay together where no split lies between.
        places, segments, words, before = places[keep], segments[keep], words[keep], len(places)
        if not len(places):
            return []
        starts = np.r_[True, (np.diff(places) > 1) | (np.diff(segments) != 0)]
        segments = np.cumsum(starts) - 1
        sizes = np.bincount(segments)
        long = sizes[segments] >= shortest
        places, segments, words = places[long], segments[long], words[long]
        if len(places) == before:
            break
    if not len(places):
        return []
    starts = np.flatnonzero(np.r_[True, np.diff(segments) != 0])
    ends = np.r_[starts[1:], len(places)]
    return list(zip(places[starts].tolist(), (places[ends - 1] + 1).tolist()))


def scan_lags(words: np.ndarray, least_words: int, least_periods: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one segment, by start and period.

    A run of period q covers ``least_periods`` neighbouring multiples of q, all
    the same word; so a lag is looked at everywhere only if that holds
    somewhere outside longer-known runs whose period divides it. A stretch
    found at a lag that was found before has the earlier, smaller period.
    """
    n = len(words)
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, n // least_periods + 1):
        marks = words[::lag]
        same = marks[1:] == marks[:-1]
        hits = same[least_periods - 2 :].copy()
        for k in range(least_periods - 2):
            hits &= same[k : len(same) - least_periods + 2 + k]
        at = np.flatnonzero(hits) * lag
        if len(at):
            for (start, end), period in found.items():
                if lag % period == 0 and end - start > lag * (least_periods - 1):
                    at = at[(at < start) | (at + lag * (least_periods - 1) >= end)]
        if not len(at):
            continue
        equal = np.r_[False, words[lag:] == words[:-lag], False].astype(np.int8)
        edges = np.diff(equal)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + lag
        long = ends - starts >= max(least_words, least_periods * lag)
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            found.setdefault((start, end), lag)
    return sorted((start, end - start, period) for (start, end), period in found.items())


def runs_of_texts(
    texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words."""
    numbers: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, sum(sizes))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    firsts = np.cumsum([0, *sizes])
    owner = np.repeat(np.arange(len(texts)), sizes)
    # Each word of a run stands in it once a period, and there are so many whole periods.
    for start, end in split_rare(flat, owner, least_periods, least_words):
        text = int(owner[start])
        offset = start - int(firsts[text])
        out[text] += [(offset + s, n, p) for s, n, p in scan_lags(flat[start:end], least_words, least_periods)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, each run cut down to its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def periodic_runs(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """The periodic runs of each text's words: ``id, n_words, runs, collapsed``.

    A run is a stretch of words with smallest period q (words q apart are the
    same) of ``least_words`` words and ``least_periods`` times q at least, that
    goes on as far as its period does. ``runs`` lists start (from 0), length
    and period by start, then period; ``collapsed`` is the text's words joined
    by spaces, without those that stand after the first period of a run.

    Null and empty texts have no words and no runs, and collapse to an empty
    text. Every row given is a row, also repeated ones and those without id;
    no rows give no rows; other columns are not read. A text is one task's
    work whatever its length; the scan of a segment of n words takes about
    n log n steps, and n more for each lag at which a run is found.
    """
    if least_periods < 2:
        raise ValueError("a run has at least two periods")
    kind = documents.schema[id_column].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, texts = 0, 0, []
            for k in range(batch.num_rows + 1):
                if k == batch.num_rows or size > BLOCK_WORDS:
                    if texts:
                        yield answer(batch.column(0).slice(start, len(texts)), texts)
                    start, size, texts = k, 0, []
                if k < batch.num_rows:
                    # Split at ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
                    texts.append(byte_texts(batch.column(1).slice(k, 1))[0].split())
                    size += len(texts[-1])

    def answer(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of_texts(texts, least_words, least_periods)
        listed = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
        kinds = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        shorter = [collapsed(words, r) for words, r in zip(texts, runs)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(map(len, texts), pa.int64()), pa.array(listed, kinds), pa.array(shorter, pa.binary()).cast(pa.string())],
            ["id", "n_words", "runs", "collapsed"],
        )

    rows = documents.select(F.col(id_column).alias("id"), plain_text(text_column).alias("text"))
    return rows.mapInArrow(find, f"id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def longest_by_exponent(runs: Column) -> Column:
    """Of listed runs, the one with the greatest length by period, exactly; the first of equal ones; null for none."""
    greater = lambda best, run: run["length"] * best["period"] > best["length"] * run["period"]
    # The outer fold starts from the first run; without one it is null.
    return F.aggregate(
        runs, F.get(runs, F.lit(0)), lambda best, run: F.when(greater(best, run), run).otherwise(best)
    )
