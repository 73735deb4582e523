"""Documents whose word shingles are alike: an exact Jaccard join by adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bucket_links import BITMAP, linked
from .common import WordHashes, byte_texts, mixed, plain_text, shingles, signed, stored

WIDTH, PERCENT = 3, 90
#: Tokens are looked at, by hash, to tell which documents can have a partner at all: of each ten,
#: this many more than a partner may lack.
SAMPLED_MORE = 1
#: Prefixes are lengthened by up to this, for as many shared tokens.
MOST_SHARED = 4
#: What verifying a candidate costs, in postings, besides its tokens.
VERIFY_COST = 8.0


def missed(n: int, percent: int) -> int:
    """How many of ``n`` tokens a linked document may lack."""
    return n - -(-n * percent // 100)


def shingle_sets(documents: DataFrame, id_column: str, text_column: str, width: int, percent: int) -> DataFrame:
    """``id, n, s1, s2, sampled``: size and hashes of each row's set, and its tokens of the sampled classes."""
    classes = np.uint64(SAMPLED_MORE + -(-(100 - percent) // 10))
    kind = documents.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, ones, twos, sampled = [], [], [], []
            for text in byte_texts(batch.column(1)):
                tokens = np.unique(shingles(hashes.of(text.lower().split()), width))
                sizes.append(len(tokens))
                ones.append(int(signed(mixed(tokens ^ np.uint64(1)).sum(dtype=np.uint64).reshape(1))[0]))
                twos.append(int(signed(mixed(tokens ^ np.uint64(2)).sum(dtype=np.uint64).reshape(1))[0]))
                sampled.append(signed(tokens[tokens % np.uint64(10) < classes]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()),
                    pa.array(sampled, pa.list_(pa.int64())),
                ],
                ["id", "n", "s1", "s2", "sampled"],
            )

    chosen = documents.select(F.col(id_column).alias("id"), plain_text(text_column).alias("text"))
    return chosen.mapInArrow(work, f"id {kind}, n long, s1 long, s2 long, sampled array<long>")


def possible(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Ids of the different sets that can have a partner.

    A partner lacks no more than ``missed(n)`` of a set's tokens, so of the
    sampled ones all but so many stand in another document. In running text
    most documents' shingles stand nowhere else and they are done here, at a
    part of what counting all tokens would take.
    """
    tokens = rows.select("id", F.explode("sampled").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token")
    common = stored(common, "common")
    known = tokens.join(common, "token", "left_semi").groupBy("id").agg(F.count_distinct("token").alias("known"))
    known = known.withColumnRenamed("id", "known_id")
    lacking = F.col("n") - F.ceil(F.col("n") * percent / 100)
    own = rows.select("id", "n", F.size("sampled").alias("own")).join(sets.select("id"), "id", "left_semi")
    own = own.join(known, F.col("id") == F.col("known_id"), "left")
    return own.where(F.coalesce("known", F.lit(0)) >= F.col("own") - lacking).select("id").distinct()


def shared_tokens(size: int, first: int, frequencies: np.ndarray, percent: int) -> int:
    """How many tokens a document's prefix should share: the cheapest by estimate.

    A prefix that asks for l shared tokens is l - 1 tokens longer. Its
    candidates are no more than its postings over l, as each has l of them; a
    candidate costs what verifying it does. ``frequencies`` are those of the
    tokens from place ``first`` on; earlier ones are in no other document.
    """
    sums = np.concatenate([[0.0], np.cumsum(frequencies)])
    best, least = 1, np.inf
    for shared in range(1, min(MOST_SHARED, size - missed(size, percent)) + 1):
        reach = min(max(0, missed(size, percent) + shared - first), len(frequencies))
        cost = sums[reach] + (VERIFY_COST + size / 16) * sums[reach] / shared
        if cost < least:
            best, least = shared, cost
    return best


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A set as ``BITMAP`` longs: each token turns one bit over."""
    at = (mixed(tokens.view(np.uint64)) % np.uint64(64 * BITMAP)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * BITMAP).astype(np.uint8) & 1).view(np.int64)


def prefix_postings(sets: DataFrame, percent: int) -> DataFrame:
    """``token, id, size, place, need, bits``: the prefix of each set (``id, tokens``), rare tokens first.

    Tokens are ordered by their frequency in the sets and by hash. Two sets that
    are alike share, of prefixes made for l shared tokens, at least l. Tokens of
    one set alone are left out; their number is known, so that places are right.
    """
    tokens = sets.select("id", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = tokens.join(stored(common, "frequencies"), "token").groupBy("id").agg(
        F.collect_list(F.struct("df", "token")).alias("known")
    )
    rows = sets.join(known, "id").select("id", F.col("tokens").alias("whole"), "known.df", "known.token")
    kind = sets.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows, sizes, places, needs, bits = [], [], [], [], [], []
            columns = (batch.column(c) for c in ("whole", "df", "token"))
            for k, (whole, df, token) in enumerate(zip(*columns)):
                n, df, token = len(whole), df.values.to_numpy(), token.values.to_numpy().view(np.uint64)
                order = np.lexsort((token, df))
                first = n - len(token)
                shared = shared_tokens(n, first, df[order], percent)
                chosen = token[order][: max(0, missed(n, percent) + shared - first)]
                out.append(signed(chosen))
                rows += [k] * len(chosen)
                sizes += [n] * len(chosen)
                places += range(first, first + len(chosen))
                needs += [shared] * len(chosen)
                bits += [bitmap(whole.values.to_numpy())] * len(chosen)
            found = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found), batch.column("id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                    pa.array(places, pa.int64()), pa.array(needs, pa.int32()), pa.array(bits, pa.list_(pa.int64())),
                ],
                ["token", "id", "size", "place", "need", "bits"],
            )

    return rows.mapInArrow(work, f"token long, id {kind}, size long, place long, need int, bits array<long>")


def whole_sets(documents: DataFrame, ids: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """``id, tokens`` of the documents whose ids are asked for, a row per id."""
    kind = documents.schema[id_column].dataType.simpleString()
    rows = documents.select(F.col(id_column).alias("id"), plain_text(text_column).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [signed(np.unique(shingles(hashes.of(t.lower().split()), width))) for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "tokens"])

    return rows.join(ids, "id", "left_semi").mapInArrow(work, f"id {kind}, tokens array<long>")


def similar_documents(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
) -> DataFrame:
    """Groups of documents by links of Jaccard similarity of at least ``percent`` of a hundred.

    Sets are the different shingles of ``width`` words in lower case (A-Z), or
    the whole sequence where a text has fewer words. Returns ``id, n_shingles,
    component_id``: the set's size and the smallest id reachable by links, the
    own one included. Equal sets are one set until the end, so copies are
    never paired. Shingles are told apart by 64-bit hashes.

    A row per row given. Texts without words (null, empty) have an empty set
    and are linked with nothing. Ids must name rows of one text; rows without id
    have no component. No rows give no rows; other columns are not read.
    """
    rows = stored(shingle_sets(documents, id_column, text_column, width, percent), "sets")
    usable = rows.where("n > 0 AND id IS NOT NULL")
    sets = stored(usable.groupBy("s1", "s2", "n").agg(F.min("id").alias("id")), "different-sets")
    asked = stored(possible(usable, sets, percent), "possible")
    whole = whole_sets(documents, asked, id_column, text_column, width)
    whole = stored(whole.groupBy("id").agg(F.first("tokens").alias("tokens")), "whole-sets")
    postings = stored(prefix_postings(whole, percent), "postings")

    def verify(pairs: DataFrame) -> DataFrame:
        first = whole.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a"))
        second = whole.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b"))
        both = F.size(F.array_intersect("tokens_a", "tokens_b"))
        met = pairs.join(first, "a").join(second, "b").select(
            "a", "b", both.alias("both"), (F.size("tokens_a") + F.size("tokens_b")).alias("all")
        )
        return met.where(F.col("both") * 100 >= (F.col("all") - F.col("both")) * percent).select("a", "b")

    labels = linked(postings, verify, percent)
    named = sets.select("s1", "s2", "n", "id").join(labels, "id", "left")
    named = named.select("s1", "s2", "n", F.coalesce("component", "id").alias("named"))
    result = rows.select("id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("named", "id"))
    return result.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents with the smallest id of their group, with their columns as given.

    Rows without id stay.
    """
    groups = similar_documents(documents, id_column, text_column, **options)
    gone = groups.where("id <> component_id").select(F.col("id").alias("__n_id"))
    return documents.join(gone, F.col(id_column) == F.col("__n_id"), "left_anti")
