"""The tables of an index version: a base and the changes since, put together on reading.

Each build or refresh writes one folder, a layer: ``chunks``, ``vectors`` and
``postings`` of its own documents, and ``gone``, the ids of chunks of earlier
layers that it takes away. A version is a list of layers, oldest first. Ids are
never used twice, so a row is live if its id is in no layer's ``gone``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clusters import probed_vectors
from ..operators.keyword import read_postings

LAYERS = "place int, layer string, clustered boolean, changes boolean, blocks boolean, words boolean"
POSTINGS = "id long, term string, pos int"
BLOCKS = (
    "term string, block long, most int, n_texts int, n_postings int, "
    "texts array<struct<id:long,positions:array<int>>>"
)


@dataclass(frozen=True)
class Layer:
    """A folder of an index.

    Says whether its vectors are also stored in clusters, whether it takes
    chunks away, whether its postings are also stored in blocks, and whether
    there are any (a layer may do no more than take chunks away).
    """

    folder: str
    name: str
    clustered: bool
    changes: bool
    blocks: bool
    words: bool = True


def write_layers(spark: SparkSession, root: str, version: str, layers: Sequence[Layer]) -> None:
    """Store the list of a version's layers in the version's own folder."""
    rows = [(place, layer.name, layer.clustered, layer.changes, layer.blocks, layer.words) for place, layer in enumerate(layers)]
    spark.createDataFrame(rows, LAYERS).coalesce(1).write.parquet(f"{root}/builds/{version}/layers")


def layers_of(spark: SparkSession, root: str, version: str) -> list[Layer]:
    """The layers of a version, oldest first; a version without a list is its own only layer."""
    try:
        rows = spark.read.schema(LAYERS).parquet(f"{root}/builds/{version}/layers").orderBy("place").collect()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return [Layer(f"{root}/builds/{version}", version, True, False, False)]
    flags = ("clustered", "changes", "blocks", "words")
    return [Layer(f"{root}/builds/{r['layer']}", r["layer"], *(r[f] for f in flags)) for r in rows]


def live(rows: DataFrame, layers: Sequence[Layer]) -> DataFrame:
    """The rows (with ``id``) of chunks that no layer has taken away."""
    gone = gone_ids(rows.sparkSession, layers)
    return rows if gone is None else rows.join(gone, "id", "left_anti")


def gone_ids(spark: SparkSession, layers: Sequence[Layer]) -> DataFrame | None:
    """The ids that layers have taken away; None where no layer has."""
    gone = [spark.read.parquet(f"{layer.folder}/gone") for layer in layers if layer.changes]
    return reduce(DataFrame.unionByName, gone) if gone else None


def posting_blocks(spark: SparkSession, layers: Sequence[Layer]) -> DataFrame:
    """The posting blocks of all layers, each layer's with numbers of their own; texts taken away are still in them."""
    if not all(layer.blocks for layer in layers):
        raise ValueError("build the index with query_tables to search it for a table of queries")
    # Older layers have their rows in folders, which readers see as a column.
    parts = [
        spark.read.schema(BLOCKS).parquet(f"{layer.folder}/blocks").drop("folder").withColumn("block", F.col("block") + place * 2**50)
        for place, layer in enumerate(layers)
        if layer.words
    ]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], BLOCKS)


def live_table(spark: SparkSession, layers: Sequence[Layer], name: str) -> DataFrame:
    """``chunks`` or ``vectors`` of a version."""
    parts = [spark.read.parquet(f"{layer.folder}/{name}") for layer in layers]
    return live(reduce(DataFrame.unionByName, parts), layers)


def live_postings(spark: SparkSession, layers: Sequence[Layer], terms: Iterable[str] | None = None) -> DataFrame:
    """The postings of a version, all or those of some terms; of these only the folders and row groups are read."""
    terms = None if terms is None else list(terms)
    folders = [f"{layer.folder}/postings" for layer in layers if layer.words]
    parts = [read_postings(spark, folder, terms) for folder in folders]
    # One part is given back as it is; without any, a version has no words.
    return live(reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], POSTINGS), layers)


def probed_table(
    spark: SparkSession, layers: Sequence[Layer], queries: Mapping[str, Sequence[float]], probes: int
) -> DataFrame:
    """The vectors that an approximate search compares: near clusters of clustered layers, and all of the others."""
    parts = [
        probed_vectors(spark, f"{layer.folder}/clusters", queries, probes).select("id", "embedding")
        if layer.clustered
        else spark.read.parquet(f"{layer.folder}/vectors").select("id", "embedding")
        for layer in layers
    ]
    return live(reduce(DataFrame.unionByName, parts), layers)
