"""Nearest vectors of a table of queries: cells of stored vectors and queries that meet in one task.

The exact and the approximate search differ only in what meets: every query and
every vector, or a query and the clusters it probes. Stored vectors and queries
are both dealt to cells of bounded size, so that a cluster (or a whole table)
with any share of the rows, and any number of queries, spreads over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import SCORE_DIGITS
from .clusters import write_clusters
from .semantic import rank_hits

#: Numbers of a cell's queries (16 MB), and of the vectors that pass by in one cell, at most.
CELL_VALUES = 2_000_000
#: Rows of one matrix product, on both sides.
QUERY_ROWS, BLOCK_ROWS = 512, 2048
#: So many shares of all vectors for each core, unless they have to be smaller.
TASKS_PER_CORE = 4
#: Probes are chosen so that of this many stored vectors, asked as queries, this share of the nearest is found.
SAMPLE, SAMPLE_NEAREST, WANTED_RECALL = 256, 10, 0.95
#: Numbers of all centres together, which go to every task (32 MB).
CENTRE_VALUES = 4_000_000


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_column: str = "query",
    id_column: str = "id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` vectors of ``corpus`` nearest to each row of ``queries``: query, id, score, rank. Exact.

    Both tables have ``vector_column``; queries are named by ``query_column``,
    of any type. Ranks follow the cosine, rounded as stored vectors allow, then
    the id; vectors of no length come last, with a null score. Null vectors are
    left out on both sides. A query that is repeated counts as one.
    """
    asked = _asked(queries, query_column, vector_column).withColumn("cluster", F.lit(0))
    stored = corpus.where(F.col(vector_column).isNotNull()).select(
        F.lit(0).alias("cluster"), F.col(id_column).alias("id"), F.col(vector_column).alias("embedding")
    )
    return _topk_of_cells(asked, stored, k)


def clustered_topk(
    spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, query_column: str = "query",
    vector_column: str = "embedding",
) -> DataFrame:
    """About the ``k`` nearest of the vectors stored by ``write_search_clusters``: query, id, score, rank.

    Each query meets the vectors of the ``probes`` clusters nearest to it, by
    default as many as were found to be needed when the clusters were written.
    """
    centres = _centres(path)
    if probes is None:
        probes = spark.read.parquet(f"{path}/probes").first()["probes"]
    asked = _asked(queries, query_column, vector_column)
    asked = asked.mapInArrow(_probing(centres, min(probes, len(centres))), f"{_fields(asked)}, cluster int, place int")
    return _topk_of_cells(asked, spark.read.parquet(f"{path}/vectors"), k)


def _centres(path: str) -> np.ndarray:
    return np.array(PipelineModel.load(f"{path}/model").stages[-1].clusterCenters())


def write_search_clusters(vectors: DataFrame, path: str, n_clusters: int | None = None) -> None:
    """Store vectors (id, embedding) in clusters, with the number of probes that finds enough of the nearest.

    How many clusters have to be probed depends on how far the vectors form
    clusters at all, so it is measured: a sample of ``SAMPLE`` stored vectors is
    searched exactly, and each of their nearest others lies in the first, second
    or later cluster of its query. The probes are as many as bring
    ``WANTED_RECALL`` of them.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding")
    first = rows.select(F.size("embedding")).first()
    if n_clusters is None:
        n_clusters = clusters_of(rows.count(), first[0] if first else 1)
    write_clusters(rows, path, n_clusters)
    centres = _centres(path)
    stored = spark.read.parquet(f"{path}/vectors")
    sample = stored.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(F.col("id").alias("query"), "embedding")
    nearest = vector_topk(sample, stored, SAMPLE_NEAREST + 1).where(F.col("id") != F.col("query"))
    places = nearest.join(stored.select("id", "cluster"), "id").select("query", "cluster")
    asked = _asked(sample, "query", "embedding")
    probed = asked.mapInArrow(_probing(centres, len(centres)), f"{_fields(asked)}, cluster int, place int")
    ranks = places.join(probed.select("query", "cluster", "place"), ["query", "cluster"]).groupBy("place").count()
    # One row per cluster at most, and there are no more clusters than every task can hold.
    counts = np.zeros(len(centres) + 1)
    for place, n in ranks.collect():
        counts[place] = n
    found = np.cumsum(counts) / max(1.0, counts.sum())
    probes = int(np.argmax(found >= WANTED_RECALL)) or len(centres)
    row = [(probes, float(found[probes]), len(centres))]
    spark.createDataFrame(row, "probes int, recall double, clusters int").coalesce(1).write.parquet(f"{path}/probes")


def clusters_of(n_vectors: int, width: int) -> int:
    """How many clusters to store vectors in: half the square root of their number, as far as all tasks can hold the centres."""
    return max(2, min(round(math.sqrt(n_vectors) / 2), CENTRE_VALUES // max(1, width)))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query of the exact answer: how many of its hits were found, of how many: query, found, wanted."""
    near = found.select("query", "id", F.lit(1).alias("met"))
    both = exact.select("query", "id").join(near, ["query", "id"], "left")
    return both.groupBy("query").agg(F.count("met").alias("found"), F.count(F.lit(1)).alias("wanted"))


def _asked(queries: DataFrame, query_column: str, vector_column: str) -> DataFrame:
    rows = queries.where(F.col(vector_column).isNotNull() & F.col(query_column).isNotNull())
    return rows.select(F.col(query_column).alias("query"), F.col(vector_column).alias("embedding")).dropDuplicates(["query"])


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = lists.flatten()
    width = width or (len(flat) // len(lists) if len(lists) else 0)
    if len(flat) != len(lists) * width:
        raise ValueError(f"every vector must have {width} dimensions, as the others have")
    return flat.to_numpy(zero_copy_only=False).astype("f8").reshape(len(lists), -1)


def _probing(centres: np.ndarray, probes: int):
    """Queries to one row per cluster that they probe, the nearest first."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (centres * centres).sum(axis=1)
        for batch in batches:
            for start in range(0, batch.num_rows, QUERY_ROWS):
                block = batch.slice(start, QUERY_ROWS)
                rows = _matrix(block.column(1), centres.shape[1])
                norms = np.linalg.norm(rows, axis=1, keepdims=True)
                rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
                far = squares[None, :] - 2 * rows @ centres.T
                near = np.argsort(far, axis=1, kind="stable")[:, :probes]
                again = np.repeat(np.arange(block.num_rows), probes)
                place = np.tile(np.arange(1, probes + 1), block.num_rows)
                columns = [pa.array(near.ravel(), pa.int32()), pa.array(place, pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).take(again), block.column(1).take(again), *columns],
                    ["query", "embedding", "cluster", "place"],
                )

    return probe


def _topk_of_cells(asked: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """Each query's best ``k`` of the vectors in its clusters.

    A cluster of many vectors is cut into shares and its queries into groups;
    each share meets each group in one cell, the vectors once per group and the
    queries once per share. The counts that say how are one row per cluster.
    """
    spark = asked.sparkSession
    first = stored.select(F.size("embedding")).first()
    width = first[0] if first else 1
    most = max(1, CELL_VALUES // max(1, width))
    # Every share hands on the k best of every query, so there are no more than keep all cores at work.
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    held = stored.groupBy("cluster").agg(F.count(F.lit(1)).alias("held"))
    asking = asked.groupBy("cluster").agg(F.count(F.lit(1)).alias("asking"))
    # Few clusters are cut finer, so that all tasks have work; a share is no smaller than a block.
    whole = F.sum("held").over(Window.partitionBy())
    share_rows = F.greatest(F.lit(float(BLOCK_ROWS)), F.least(F.lit(float(most)), whole / tasks))
    cells = held.withColumn("shares", F.ceil(F.col("held") / share_rows).cast("int")).join(asking, "cluster")
    cells = cells.select("cluster", "shares", F.ceil(F.col("asking") / most).cast("int").alias("groups"))

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Rows with their own place, and each place on the other side."""
        placed = rows.join(cells, "cluster").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))

    id_type = stored.schema["id"].dataType.simpleString()
    query_type = asked.schema["query"].dataType.simpleString()
    cell = ["cluster", "share", "group"]
    vectors = F.col("embedding").cast("array<double>").alias("embedding")
    left = dealt(asked, "query", "group", "share").select(
        *cell, "query", F.lit(None).cast(id_type).alias("id"), vectors, F.lit(False).alias("stored")
    )
    right = dealt(stored, "id", "share", "group").select(
        *cell, F.lit(None).cast(query_type).alias("query"), "id", vectors,
        F.lit(True).alias("stored"),
    )
    met = left.unionByName(right).repartition(*cell).sortWithinPartitions(*cell, "stored", F.col("id").asc_nulls_last())
    scored = met.mapInArrow(_best_of_cells(k), f"query {query_type}, id {id_type}, score double")
    return rank_hits(scored, k, 0)


def _best_of_cells(k: int):
    """Rows of cells, queries before vectors and these by id, to the best ``k`` ids of each query and cell."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, best = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            kinds = batch.column(6).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (kinds[1:] != kinds[:-1])])
            for start, end in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
                if cell != tuple(keys[start]):
                    if best is not None:
                        yield best.hits()
                    cell, asked, best = tuple(keys[start]), [], None
                rows = batch.slice(start, end - start)
                if not kinds[start]:
                    asked.append(rows)
                elif asked:
                    best = best or _Best(asked, k)
                    best.meet(rows.column(4), rows.column(5))
        if best is not None:
            yield best.hits()

    return score


class _Best:
    """The best ids of a cell's queries so far. Vectors come by id, so that of equal scores the first ones stay."""

    def __init__(self, asked: list[pa.RecordBatch], k: int):
        self.names = pa.concat_arrays([b.column(3) for b in asked])
        rows = np.concatenate([_matrix(b.column(5)) for b in asked])
        self.parts = [_BestOfFew(at, rows[at : at + QUERY_ROWS], k) for at in range(0, len(rows), QUERY_ROWS)]
        self.width = rows.shape[1]

    def meet(self, ids: pa.Array, lists: pa.Array) -> None:
        for start in range(0, len(ids), BLOCK_ROWS):
            rows = _matrix(lists.slice(start, BLOCK_ROWS), self.width)
            norms = np.linalg.norm(rows, axis=1)
            units = _units(rows, norms)
            for part in self.parts:
                part.meet(ids.slice(start, BLOCK_ROWS), rows, norms, units)

    def hits(self) -> pa.RecordBatch:
        kept = pa.concat_tables([part.kept for part in self.parts])
        scores = kept["score"].to_numpy()
        return pa.RecordBatch.from_arrays(
            [
                self.names.take(kept["query"].combine_chunks()),
                kept["id"].combine_chunks(),
                pa.array(scores, mask=np.isneginf(scores)),
            ],
            ["query", "id", "score"],
        )


class _BestOfFew:
    """The best ids of the queries of one matrix product, which start at the cell's query ``first``."""

    def __init__(self, first: int, rows: np.ndarray, k: int):
        self.first, self.rows, self.k = first, rows, k
        self.norms = np.linalg.norm(rows, axis=1)
        self.units = _units(rows, self.norms)
        self.full = np.zeros(len(rows), dtype=bool)
        self.least = np.full(len(rows), -np.inf)
        self.kept: pa.Table | None = None

    def meet(self, ids: pa.Array, rows: np.ndarray, norms: np.ndarray, units: np.ndarray) -> None:
        # A query whose k scores are all as high as any can be, or that has no length, needs no more than k ids.
        asked = np.flatnonzero(~self.full | ((self.least < 1.0) & (self.norms > 0)))
        if not len(asked):
            return
        about = self.units[asked] @ units.T
        about[:, ~(norms > 0)] = -np.inf
        about[~(self.norms[asked] > 0)] = -np.inf
        # Only what can round to more than a query's last hit has, and to the block's k best, is scored to the last bit.
        least = np.where(self.full[asked], self.least[asked] + 0.4 * 10.0**-SCORE_DIGITS, -np.inf)
        open_ones = np.flatnonzero(~self.full[asked])
        if len(ids) > self.k and len(open_ones):
            least[open_ones] = np.partition(about[open_ones], -self.k, axis=1)[:, -self.k] - 1.1 * 10.0**-SCORE_DIGITS
        query, place = np.nonzero(about >= least[:, None])
        query = asked[query]
        scores = np.empty(len(query))
        for at in range(0, len(query), BLOCK_ROWS):
            q, p = query[at : at + BLOCK_ROWS], place[at : at + BLOCK_ROWS]
            with np.errstate(divide="ignore", invalid="ignore"):
                scores[at : at + BLOCK_ROWS] = np.einsum("ij,ij->i", self.rows[q], rows[p]) / norms[p] / self.norms[q]
        scores = np.round(scores, SCORE_DIGITS)
        scores[np.isnan(scores)] = -np.inf
        better = ~self.full[query] | (scores > self.least[query])
        if self.kept is None or better.any():
            self.keep(query[better], ids.take(pa.array(place[better])), scores[better])

    def keep(self, query: np.ndarray, ids: pa.Array, scores: np.ndarray) -> None:
        """Merge hits of some queries into what is kept, and raise the scores they have to reach."""
        new = pa.table({"query": query + self.first, "id": ids, "score": scores})
        table = new if self.kept is None else pa.concat_tables([self.kept, new])
        table = table.sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
        order = table["query"].to_numpy()
        starts = np.flatnonzero(np.r_[True, order[1:] != order[:-1]])
        sizes = np.diff(np.r_[starts, len(order)])
        rank = np.arange(len(order)) - np.repeat(starts, sizes)
        self.kept = table.take(pa.array(np.flatnonzero(rank < self.k)))
        full = sizes >= self.k
        last = starts[full] + self.k - 1
        self.least[order[last] - self.first] = table["score"].to_numpy()[last]
        self.full[order[last] - self.first] = True


def _units(rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of length one; those without a length are all zero."""
    long = norms > 0
    return np.where(long[:, None], rows, 0.0) / np.where(long, norms, 1.0)[:, None]
