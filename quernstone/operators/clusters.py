"""Approximate nearest vectors: only the clusters around a query are read."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .semantic import semantic_topk

PROBES = 8
SEED = 17


def write_clusters(vectors: DataFrame, path: str, n_clusters: int | None = None) -> None:
    """Store (id, embedding) in one folder per cluster of similar directions, with the centres beside them.

    The centres are found on all vectors; by default there are half as many as
    the square root of the number of vectors. The rebalancing shuffle splits a
    cluster that holds a large share of them.
    """
    rows = vectors.where(F.col("embedding").isNotNull())
    count = rows.count()
    wanted = max(2, n_clusters or round(math.sqrt(count) / 2))
    features = rows.withColumn("__features", array_to_vector("embedding"))
    unit = Normalizer(inputCol="__features", outputCol="__unit")
    centres = KMeans(k=wanted, featuresCol="__unit", predictionCol="cluster", seed=SEED, maxIter=10).fit(
        unit.transform(features)
    )
    model = PipelineModel([unit, centres])
    model.write().overwrite().save(f"{path}/model")
    placed = model.transform(features).select("id", "embedding", "cluster")
    clustered = placed.hint("rebalance", "cluster").sortWithinPartitions("cluster", "id")
    clustered.write.partitionBy("cluster").parquet(f"{path}/vectors")


def cluster_topk(
    spark: SparkSession, path: str, queries: Mapping[str, Sequence[float]], k: int, probes: int | None = PROBES
) -> DataFrame:
    """About the ``k`` nearest vectors of each query: query, id, score, rank.

    Reads the folders of the ``probes`` clusters nearest to each query; with as
    many probes as there are clusters, or with None, the answer is exact.
    """
    return semantic_topk(probed_vectors(spark, path, queries, probes), queries, k)


def probed_vectors(
    spark: SparkSession, path: str, queries: Mapping[str, Sequence[float]], probes: int | None = PROBES
) -> DataFrame:
    """The stored vectors of the clusters nearest to some queries; their folders are all that is read."""
    centres = np.array(PipelineModel.load(f"{path}/model").stages[-1].clusterCenters())
    near: set[int] = set()
    for vector in queries.values():
        query = np.asarray(vector, dtype="f8")
        unit = query / (np.linalg.norm(query) or 1.0)
        near |= set(np.argsort(((centres - unit) ** 2).sum(axis=1), kind="stable")[:probes].tolist())
    return spark.read.parquet(f"{path}/vectors").where(F.col("cluster").isin(sorted(near)))
