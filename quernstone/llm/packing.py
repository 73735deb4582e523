"""Best-fit packing of token pieces: length patterns by non-negative least squares, best fit for the rest."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain_text, stored

MAX_TOKENS = 1024
END = 2
#: Patterns are fitted so often at most, each time to what is left.
REFITS = 5
_HELD_CHUNKS = 400_000
#: Before such a space, a chunk would not be what the whole text is cut into.
_JOINED = re.compile(r"\s ")
_BUCKETS = 64


def _tokenizer(name: str):
    """Token ids of a text as little-endian 32-bit bytes.

    The vocabulary cuts a text before every single space between words, so ids
    of what stands between such spaces are worked out once and held. Texts with
    other white space before a space, or with the name of a special token, are
    tokenized whole by the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    chunked = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    class Held(dict):
        def __missing__(self, chunk: str) -> bytes:
            if len(self) >= _HELD_CHUNKS:
                self.clear()
            value = self[chunk] = np.array(chunked.encode_ordinary(" " + chunk), "<u4").tobytes()
            return value

    held = Held()

    def ids(text: str) -> bytes:
        if any(s in text for s in special) or _JOINED.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(chunked.encode_ordinary(first), "<u4").tobytes() + b"".join(map(held.__getitem__, rest))

    return ids


def token_pieces(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str = "byte_bpe_50k",
    max_tokens: int = MAX_TOKENS,
    end: int = END,
) -> DataFrame:
    """Pieces of each document's ids: ``id, piece, start, length, ids_crc32``.

    Whole texts are tokenized and ``end`` is put behind them. Documents of more
    than ``max_tokens`` ids are cut so that all pieces but the first are full.
    Null and empty texts are one piece of ``end`` alone. A repeated row is a
    document of its own.
    """
    tail = np.array([end], "<u4").tobytes()
    kind = documents.schema[id_column].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _tokenizer(vocabulary)
        for batch in batches:
            keys, pieces, starts, lengths, sums = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                data = ids(text) + tail
                n = len(data) // 4
                first = (n - 1) % max_tokens + 1
                for piece, start in enumerate((0, *range(first, n, max_tokens))):
                    end_at = first if piece == 0 else start + max_tokens
                    keys.append(k)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(end_at - start)
                    sums.append(zlib.crc32(data[4 * start : 4 * end_at]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keys, pa.int64())),
                    pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select(F.col(id_column).alias("id"), plain_text(text_column).alias("text")).mapInArrow(
        cut, f"id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def length_patterns(max_tokens: int, step: int) -> np.ndarray:
    """Rows of three lengths, the largest first and 0 for none, that fill a sequence.

    All pairs; and all triples whose two smaller lengths are ``step`` apart or
    less often, so that the number of patterns is bounded by ``max_tokens`` alone.
    """
    half = np.arange(1, max_tokens // 2 + 1)
    pairs = np.stack([max_tokens - half, half, np.zeros_like(half)], axis=1)
    triples = [
        (max_tokens - b - c, b, c)
        for c in range(1, max_tokens // 3 + 1)
        for b in range(c, (max_tokens - c) // 2 + 1, step)
        if max_tokens - b - c >= b
    ]
    return np.concatenate([[[max_tokens, 0, 0]], pairs, np.array(triples, dtype=int).reshape(-1, 3)])


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts of the patterns by non-negative least squares against the histogram.

    Accelerated projected gradient descent; rows of the pattern matrix have at
    most three entries, so products are gathers and weighted bin counts.
    """
    size = len(histogram)
    target = histogram.astype(float)
    target[0] = 0

    def covered(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(patterns[:, k], weights=x, minlength=size) for k in range(3))
        out[0] = 0
        return out

    x = np.zeros(len(patterns))
    # The largest eigenvalue of the normal matrix, by power iteration.
    v = np.ones(len(patterns))
    for _ in range(20):
        c = covered(v)
        w = c[patterns].sum(axis=1)
        norm = np.linalg.norm(w) / max(np.linalg.norm(v), 1e-300)
        v = w / max(np.linalg.norm(w), 1e-300)
    y, t = x, 1.0
    for _ in range(rounds):
        error = covered(y) - target
        error[0] = 0
        new = np.maximum(0.0, y - error[patterns].sum(axis=1) / (1.05 * norm))
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / later * (new - x)
        x, t = new, later
    return x


def plan_sequences(histogram: np.ndarray, max_tokens: int = MAX_TOKENS, step: int = 8) -> list[tuple[int, ...]]:
    """``(times, length, length, ...)``: sequences that hold exactly the histogram's pieces.

    Fitted counts are rounded down and taken as far as the histogram goes, the
    most used first; then patterns are fitted to what is left, rounded to the
    nearest, as long as that places pieces. The rest is packed by best fit,
    largest first, over counts rather than pieces, so that the work depends on
    ``max_tokens`` and not on how many pieces there are. Where pieces are few,
    rounding costs more than patterns gain: of the plans after each round, and
    of best fit alone, the one of fewest sequences is taken.
    """
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[int, ...]] = [(int(left[max_tokens]), max_tokens)] if left[max_tokens] else []
    left[max_tokens] = 0
    patterns = length_patterns(max_tokens, step)[1:]
    options = []
    for turn in range(REFITS):
        patterns = patterns[((left[patterns] > 0) | (patterns == 0)).all(axis=1)]
        if not len(patterns):
            break
        fitted = fit_counts(patterns, left)
        counts = np.floor(fitted + (0.5 if turn else 1e-6)).astype(np.int64)
        placed = False
        for k in np.argsort(-fitted, kind="stable"):
            if counts[k]:
                need = np.bincount(patterns[k][patterns[k] > 0], minlength=len(left))
                at = need > 0
                times = int(min(counts[k], (left[at] // need[at]).min()))
                if times > 0:
                    left -= need * times
                    plan = [*plan, (times, *(int(p) for p in patterns[k] if p))]
                    placed = True
        if not placed:
            break
        options.append(plan + best_fit(left, max_tokens))
    options.append(best_fit(histogram, max_tokens))
    return min(options, key=lambda option: sum(times for times, *_ in option))


def best_fit(histogram: np.ndarray, max_tokens: int) -> list[tuple[int, ...]]:
    """Best fit, largest first, of counted lengths into alike sequences: ``(times, length, ...)``."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}

    def put(content: tuple[int, ...], times: int) -> None:
        room = max_tokens - sum(content)
        open_.setdefault(room, {})
        open_[room][content] = open_[room].get(content, 0) + times

    for length in range(max_tokens, 0, -1):
        count = int(histogram[length])
        while count:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                # Sequences of this length alone, each as full as it gets.
                each = max_tokens // length
                if count >= each:
                    put((length,) * each, count // each)
                if count % each:
                    put((length,) * (count % each), 1)
                break
            content, times = open_[room].popitem()
            each = room // length
            used = min(times, count // each)
            if used:
                put(content + (length,) * each, used)
                count -= used * each
            else:
                put(content + (length,) * count, 1)
                used, count = 1, 0
            if times > used:
                open_[room][content] = times - used
            if not open_[room]:
                del open_[room]
    return [(times, *content) for by_content in open_.values() for content, times in by_content.items()]


def slots(plan: list[tuple[int, ...]]) -> np.ndarray:
    """Rows ``length, first rank, sequence, offset``, sorted: where the pieces of a length go, in runs."""
    rows, sequence, ranks = [], 0, {}
    for times, *lengths in plan:
        offset = 0
        for length in lengths:
            rank = ranks.get(length, 0)
            rows.append((length, rank, sequence, offset))
            ranks[length] = rank + times
            offset += length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (``id, piece, length, ...``).

    The driver sees the histogram of lengths (``max_tokens`` rows) and makes the
    plan from it. A piece's rank within its length is its rank within a hash
    bucket plus the bucket's start, so that no length meets in one task; its
    place then follows from the plan alone.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(_bucket_count(spark))).cast("int"))
    counted = stored(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(max_tokens + 1, dtype=np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    table = slots(plan_sequences(histogram, max_tokens))
    # One key orders both: ranks are far below 2**50.
    keys = table[:, 0] * 2**50 + table[:, 1]
    order = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first")).drop("bucket", "first")
    held = spark.sparkContext.broadcast((keys, table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = held.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = table[np.searchsorted(keys, length * 2**50 + rank, side="right") - 1]
            columns = [batch.column(c) for c in names] + [pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def _bucket_count(spark) -> int:
    return max(_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Pieces of all documents with their places: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    See ``token_pieces`` for null, empty and repeated rows. No rows give no
    rows; other columns are not read.
    """
    pieces = stored(token_pieces(documents, id_column, text_column, **options), "pieces")
    return pack(pieces, options.get("max_tokens", MAX_TOKENS))
