"""Keyword search over a postings table: one row per (id, term, pos)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SLICE_ROWS, english_index, explode_index
from ..functions.vector import SCORE_DIGITS
from ..sources.scratch import ADVISORY, released, size_of
from .semantic import rank_hits

# Fixed value: weight of a word of ordinary text in PostgreSQL's cover density rank.
WORD_WEIGHT = 0.1
# A stored postings table has one folder per this many texts.
BUCKET_TEXTS = 50_000
#: So many words of a task meet by term before they are shuffled.
GROUP_POSTINGS = 2**20
#: So many unpacked rows are handed on at a time.
UNPACKED_ROWS = 10_000


def postings(df: DataFrame, id_column: str = "id", text_column: str = "content") -> DataFrame:
    """id, term, pos of every indexed word of a text column. Stop words keep their positions."""
    return explode_index(text_words(df, id_column, text_column), ["id"], "words")


def text_words(df: DataFrame, id_column: str = "id", text_column: str = "content") -> DataFrame:
    """id, words of every text: its index words by position, null where a stop word stood."""
    return df.select(F.col(id_column).alias("id"), english_index(F.col(text_column)).alias("words"))


def write_postings(words: DataFrame, path: str, n_texts: int) -> None:
    """Store postings in folders by hash of the term, sorted by term, so that a search opens few row groups.

    ``words`` are postings (id, term, pos) or, which is faster, texts (id, words).
    The words of a task first meet by term: a stored row (term, ids, positions)
    is a term with its places in many texts, so that far fewer rows are sorted
    than there are words. They are packed by folder for the shuffle. It
    rebalances, so that Spark can split a folder that one frequent term fills
    over several tasks, by size, without looking at the data beforehand.
    """
    spark, buckets = words.sparkSession, max(1, n_texts // BUCKET_TEXTS)
    whole = "words" in words.columns
    kinds = [words.schema["id"].dataType.simpleString(), "int" if whole else words.schema["pos"].dataType.simpleString()]
    grouped = words.select("id", *(["words"] if whole else ["term", "pos"])).mapInArrow(_by_term(buckets), "bucket int, packed binary")
    rows = grouped.hint("rebalance", "bucket").mapInArrow(
        _unpacked, f"bucket int, term string, ids array<{kinds[0]}>, positions array<{kinds[1]}>"
    )
    clustered = rows.withColumn("n_parts", F.lit(buckets)).sortWithinPartitions("bucket", "term")
    # Rows take about three times as much as they do when packed.
    with released(spark, {ADVISORY: str(max(1, size_of(spark.conf.get(ADVISORY)) // 3))}):
        clustered.write.option("compression", "zstd").partitionBy("n_parts", "bucket").parquet(path)


def _by_term(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings or texts to a row per bucket, with its words packed by term, for about ``GROUP_POSTINGS`` words at a time."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for rows in _spread(batch) if "words" in batch.schema.names else [batch]:
                columns = [rows["id"].dictionary_encode(), rows["term"].dictionary_encode(), rows["pos"]]
                held.append(pa.RecordBatch.from_arrays(columns, ["id", "term", "pos"]))
                n += rows.num_rows
                if n >= GROUP_POSTINGS:
                    yield _grouped(held, buckets)
                    held, n = [], 0
        if n:
            yield _grouped(held, buckets)
        # Workers are used again by other tasks, and would keep what they once needed.
        held.clear()
        pa.default_memory_pool().release_unused()

    return group


def _spread(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Texts (id, words, and what else) to postings (id, term, pos), ``SLICE_ROWS`` texts at a time."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        texts = batch.slice(at, SLICE_ROWS)
        sizes = pc.fill_null(pc.list_value_length(texts["words"]), 0).to_numpy(zero_copy_only=False)
        pos = np.arange(1, sizes.sum() + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        others = texts.drop_columns(["words"]).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        words = [texts["words"].flatten(), pa.array(pos, pa.int32())]
        rows = pa.RecordBatch.from_arrays([*others.columns, *words], [*others.schema.names, "term", "pos"])
        yield rows.filter(pc.is_valid(rows["term"]))


def _grouped(batches: Sequence[pa.RecordBatch], buckets: int) -> pa.RecordBatch:
    """Words (id, term, pos) to the bytes of each bucket: its terms, how often each occurs, and where."""
    rows = pa.Table.from_batches(batches).unify_dictionaries()
    (ids, text), (terms, code) = (coded(rows[c].combine_chunks()) for c in ("id", "term"))
    pos = rows["pos"].combine_chunks()
    bucket = np.array([_bucket_of(term, buckets) for term in terms.to_pylist()], "i4")
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), "i4")
    place[order] = np.arange(len(order))
    # Words by bucket, term and, as they came, text.
    code = place[code]
    words = in_order(code)
    sizes = np.bincount(code, minlength=len(terms))
    ends = np.r_[0, np.cumsum(sizes)]
    starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, "i8")
    packed = []
    for start, end in zip(starts, np.r_[starts[1:], len(order)]):
        own = words[ends[start] : ends[end]]
        used, which = used_of(text[own], len(ids))
        steps = np.diff(which, prepend=np.int32(0))
        columns = [terms.take(pa.array(order[start:end])), pa.array(sizes[start:end], pa.int32()), ids.take(pa.array(used)),
                   pa.array(steps), pos.take(pa.array(own))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        packed.append(bytes_of(pa.RecordBatch.from_arrays(lists, ["term", "size", "id", "step", "pos"])))
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][starts]), pa.array(packed, pa.binary())], ["bucket", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed words of buckets to a row (bucket, term, ids, positions) per term."""
    for batch in batches:
        for bucket, table in zip(batch["bucket"].to_pylist(), tables_of(batch["packed"])):
            term, size, ids, step, pos = (table[c].combine_chunks().flatten() for c in ("term", "size", "id", "step", "pos"))
            ids = ids.take(pa.array(np.cumsum(step.to_numpy(), dtype="i4")))
            ends = pa.array(np.r_[0, np.cumsum(size.to_numpy())], pa.int32())
            for at in range(0, len(term), UNPACKED_ROWS):
                own = ends.slice(at, UNPACKED_ROWS + 1)
                lists = [pa.ListArray.from_arrays(own, column) for column in (ids, pos)]
                held = min(UNPACKED_ROWS, len(term) - at)
                columns = [pa.array(np.full(held, bucket), pa.int32()), term.slice(at, held), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "term", "ids", "positions"])


def coded(column: pa.DictionaryArray) -> tuple[pa.Array, np.ndarray]:
    """The different values in order, null as the last one, and the place of each row's value among them."""
    order = pc.sort_indices(column.dictionary).to_numpy()
    place = np.empty(len(order) + 1, "i4")
    place[order], place[-1] = np.arange(len(order)), len(order)
    values = column.dictionary.take(pa.array(order))
    if column.null_count:
        values = pa.concat_arrays([values, pa.nulls(1, values.type)])
    return values, place[pc.fill_null(column.indices, -1).to_numpy()]


def in_order(codes: np.ndarray) -> np.ndarray:
    """The places of 32-bit codes in their order, equal ones as they come: ``argsort``, at a fraction of its time."""
    return np.sort(codes.astype("i8") << 32 | np.arange(len(codes))) & (2**32 - 1)


def used_of(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` codes occur, in order, and the place of each among them."""
    if 8 * len(codes) < n:
        used, place = np.unique(codes, return_inverse=True)
        return used, place.astype("i4")
    held = np.zeros(n, dtype=bool)
    held[codes] = True
    return np.flatnonzero(held), (np.cumsum(held, dtype="i4") - 1)[codes]


def bytes_of(batch: pa.RecordBatch) -> bytes:
    """Some rows as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tables_of(packed: pa.Array | pa.ChunkedArray) -> Iterator[pa.Table]:
    """The rows of each ``bytes_of``."""
    return (pa.ipc.open_stream(each.as_buffer()).read_all() for each in packed)


def read_postings(spark: SparkSession, path: str, terms: Iterable[str] | None = None) -> DataFrame:
    """The stored postings (id, term, pos), all or those of some terms; of these only the folders and row groups are read."""
    stored = spark.read.parquet(path)
    if terms is None:
        return _places(stored)
    # An older index has its folders by another hash.
    older = "n_buckets" in stored.columns
    buckets = stored.select("n_buckets" if older else "n_parts").first()
    if buckets is None:
        return _places(stored)
    terms = list(terms)
    folders = [_bucket(F.lit(t), buckets[0]) if older else F.lit(_bucket_of(t, buckets[0])) for t in terms]
    return _places(stored.where(F.col("bucket").isin(folders) & F.col("term").isin(terms)))


def _places(stored: DataFrame) -> DataFrame:
    """A row per word of stored postings."""
    if "pos" in stored.columns:  # an older index has them as such
        return stored.select("id", "term", "pos")
    places = stored.select("term", F.explode(F.arrays_zip("ids", "positions")).alias("at"))
    return places.select(F.col("at.ids").alias("id"), "term", F.col("at.positions").alias("pos"))


def _bucket_of(term: str | None, buckets: int) -> int:
    return zlib.crc32((term or "").encode()) % buckets


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def query_terms(spark: SparkSession, queries: Mapping[str, str]) -> dict[str, list[str]]:
    """Distinct terms of the caller's query texts, by the rules of the postings."""
    asked = spark.createDataFrame(list(queries.items()), "query string, text string")
    terms = F.array_distinct(F.array_compact(english_index(F.col("text"))))
    return {row["query"]: row["terms"] for row in asked.select("query", terms.alias("terms")).collect()}


def keyword_match(postings: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Ids of the texts that hold every term; none for a query without terms."""
    wanted = postings.where(F.col("term").isin(list(terms)))
    found = wanted.groupBy("id").agg(F.count_distinct("term").alias("found"))
    return found.where((F.col("found") == len(set(terms))) & F.lit(bool(terms))).select("id")


def keyword_topk(postings: DataFrame, queries: Mapping[str, Sequence[str]], k: int) -> DataFrame:
    """The ``k`` texts ranking highest for each query's terms: query, id, score, rank."""
    return rank_hits(cover_density(postings, queries), k, len(queries))


def cover_density(postings: DataFrame, queries: Mapping[str, Sequence[str]]) -> DataFrame:
    """Score of every text that holds all terms of a query: query, id, score.

    A cover is a shortest span holding every term of the query. It scores
    ``WORD_WEIGHT`` divided by one plus the number of other words in it, and a
    text scores the sum over its covers. The postings are filtered by term in
    the scan, then shuffled once by query and text; a term that half of all
    texts contain therefore spreads like any other.
    """
    if not queries:
        raise ValueError("at least one query is needed")
    asked = [
        (term, query, number, len(set(terms)))
        for query, terms in queries.items()
        for number, term in enumerate(dict.fromkeys(terms))
    ]
    spark = postings.sparkSession
    pairs = spark.createDataFrame(asked, "term string, query string, number int, n_terms int")
    postings = postings.where(F.col("term").isin(sorted({a[0] for a in asked})))
    hits = postings.join(pairs, "term").select("query", "id", "number", "n_terms", "pos")
    if any(a[3] > 1 for a in asked):
        # Most texts lack a term; their postings are left out before anything is sorted.
        counted = hits.groupBy("query", "id", "n_terms").agg(F.count_distinct("number").alias("found"))
        whole = counted.where("found = n_terms").select("query", "id")
        hits = hits.join(whole, ["query", "id"], "left_semi")
    return score_covers(hits, max((a[3] for a in asked), default=0))


def score_covers(hits: DataFrame, most: int) -> DataFrame:
    """Sum over the covers of each query and text: query, id, score.

    ``hits`` has the positions at which a query's terms stand: query, id,
    number (of the term within the query), n_terms, pos. ``most`` is the
    greatest ``n_terms``.
    """
    in_text = Window.partitionBy("query", "id").orderBy("pos")
    so_far = in_text.rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("at", F.row_number().over(in_text))
    spot = F.struct(F.col("at"), F.col("pos"))
    latest = [F.max(F.when(F.col("number") == t, spot)).over(so_far) for t in range(most)]
    hits = hits.select("query", "id", "n_terms", "at", "pos", *[c.alias(f"latest_{t}") for t, c in enumerate(latest)])
    # A span ending here starts at the term seen longest ago, once every term has been seen.
    seen = [F.col(f"latest_{t}") for t in range(most)]
    complete = reduce(
        lambda a, b: a & b, [(F.col("n_terms") <= t) | c.isNotNull() for t, c in enumerate(seen)], F.lit(True)
    )
    start = F.array_min(F.array(*seen)) if seen else F.lit(None).cast("struct<at:int,pos:int>")
    spans = hits.select("query", "id", "at", "pos", F.when(complete, start).alias("start"))
    # It is a shortest one unless the span before it had the same start.
    earlier = F.lag("start.at").over(in_text)
    spans = spans.withColumn("is_cover", earlier.isNull() | (F.col("start.at") > earlier))
    others = (F.col("pos") - F.col("start.pos")) - (F.col("at") - F.col("start.at"))
    covers = spans.where(F.col("start").isNotNull() & F.col("is_cover"))
    scored = covers.groupBy("query", "id").agg(F.sum(F.lit(WORD_WEIGHT) / (1 + others)).alias("score"))
    return scored.withColumn("score", F.round("score", SCORE_DIGITS))
