"""Nearest vectors by cosine similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import SCORE_DIGITS

# Query numbers held by one pass over the corpus (64 MB of doubles); more queries make more passes.
QUERY_VALUES = 8_000_000
# Vectors scored at a time inside a task.
BLOCK_ROWS = 2048


def semantic_topk(
    corpus: DataFrame,
    queries: Mapping[str, Sequence[float]],
    k: int,
    id_column: str = "id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` corpus vectors nearest to each query: query, id, score, rank. Exact.

    The queries are the caller's own list and travel with the tasks; the corpus
    never moves. A task scores its rows in blocks of one matrix product and
    hands on its ``k`` best per query, which is all that is shuffled.
    """
    if not queries:
        raise ValueError("at least one query vector is needed")
    width = len(next(iter(queries.values())))
    per_pass = max(1, QUERY_VALUES // max(1, width))
    names = list(queries)
    vectors = corpus.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), vector_column)
    id_type = vectors.schema["id"].dataType.simpleString()
    passes = []
    for at in range(0, len(names), per_pass):
        part = names[at : at + per_pass]
        matrix = np.array([queries[name] for name in part], dtype="f8")
        passes.append(
            vectors.mapInArrow(_best_of_task(part, matrix, k), f"query string, id {id_type}, score double")
        )
    return rank_hits(reduce(DataFrame.unionByName, passes), k, len(names))


def rank_hits(scored: DataFrame, k: int | None, n_queries: int) -> DataFrame:
    """The ``k`` best rows per query (None: all), numbered from 1; ids break ties, unknown scores come last."""
    order = [F.col("score").desc_nulls_last(), F.col("id").asc()]
    if n_queries == 1 and k is not None:
        # Each task keeps its best k; only those are numbered.
        scored = scored.orderBy(*order).limit(k)
    numbered = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return numbered if k is None else numbered.where(F.col("rank") <= k)


def _best_of_task(names: list[str], matrix: np.ndarray, k: int) -> Callable:
    norms = np.linalg.norm(matrix, axis=1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pa.Table | None] = [None] * len(names)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(start, BLOCK_ROWS)
                ids, lists = block.column(0), block.column(1)
                flat = lists.flatten()
                if len(flat) != len(lists) * matrix.shape[1]:
                    raise ValueError(f"every vector must have {matrix.shape[1]} dimensions, as the query has")
                rows = flat.to_numpy(zero_copy_only=False).astype("f8").reshape(len(lists), -1)
                lengths = np.sqrt((rows * rows).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = np.round((rows @ matrix.T) / lengths[:, None] / norms[None, :], SCORE_DIGITS)
                sortable = np.where(np.isnan(scores), -np.inf, scores)
                for q in range(len(names)):
                    column = sortable[:, q]
                    if len(column) > k:
                        # Ties with the k-th stay in, so that ids can decide below.
                        keep = np.flatnonzero(column >= np.partition(column, -k)[-k])
                    else:
                        keep = np.arange(len(column))
                    found = pa.table({"id": ids.take(pa.array(keep)), "score": pa.array(column[keep])})
                    best[q] = _first(found if best[q] is None else pa.concat_tables([best[q], found]), k)
        for name, hits in zip(names, best):
            if hits is not None:
                scores = hits["score"].to_numpy()
                yield pa.record_batch(
                    {
                        "query": pa.array([name] * len(hits), pa.string()),
                        "id": hits["id"].combine_chunks(),
                        "score": pa.array(scores, mask=np.isneginf(scores)),
                    }
                )

    def _first(hits: pa.Table, k: int) -> pa.Table:
        return hits.sort_by([("score", "descending"), ("id", "ascending")]).slice(0, k)

    return scan


# Approximate search: hash tables over random projections.
LSH_BUCKET_LENGTH, LSH_TABLES, LSH_SEED = 0.5, 6, 17


def lsh_index(
    corpus: DataFrame, vector_column: str = "embedding"
) -> tuple[BucketedRandomProjectionLSHModel, DataFrame]:
    """A hashing model and the corpus with its hashes, worth writing once and searching often."""
    featured = corpus.where(F.col(vector_column).isNotNull()).withColumn("features", array_to_vector(vector_column))
    model = BucketedRandomProjectionLSH(
        inputCol="features",
        outputCol="hashes",
        bucketLength=LSH_BUCKET_LENGTH,
        numHashTables=LSH_TABLES,
        seed=LSH_SEED,
    ).fit(featured)
    return model, model.transform(featured)


def semantic_lsh_topk(
    model: BucketedRandomProjectionLSHModel,
    hashed: DataFrame,
    query: Sequence[float],
    k: int,
    id_column: str = "id",
) -> DataFrame:
    """About the ``k`` nearest of unit-length vectors: id, score.

    Compares the vectors that share a bucket with the query. Vectors that lie as
    close together as those of the test tables nearly all do; ``clusters`` reads less.
    """
    near = model.approxNearestNeighbors(hashed, Vectors.dense(query), k, distCol="distance")
    # Between unit vectors, squared distance is twice one minus cosine.
    score = F.round(1 - F.col("distance") * F.col("distance") / 2, SCORE_DIGITS)
    return near.select(F.col(id_column).alias("id"), score.alias("score"))
