"""Bring an index up to date with its documents without building it anew."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import TfidfEmbedder
from ..sources.build_log import append_status, index_status
from ..sources.scratch import kept
from .index import Model, build_index, embedded, text_hash, write_chunks, write_words
from .layers import Layer, layers_of, live_table, write_layers

#: A refresh of an index with so many layers merges them into one.
MOST_LAYERS = 8


def document_changes(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """What differs between documents and an index: source_path, text_hash, copies, change (``new`` or ``gone``).

    A document is its path and the hash of its text, with the number of its
    copies; a changed text is a document gone and a new one. ``chunks`` are
    those of the index. Texts without any chunk (null, or blank and longer than
    a chunk) are no part of an index; they count as new each time and add
    nothing. Only paths and hashes are shuffled.
    """
    key = ["source_path", "text_hash"]
    now = documents.where(F.col("text").isNotNull()).select(
        F.col("source_path").cast("string").alias("source_path"), text_hash(F.col("text")).alias("text_hash")
    )
    sides = now.select(*key, F.lit(1).alias("now"), F.lit(0).alias("before")).unionByName(
        # Every document in an index has exactly one chunk of index 0.
        chunks.where("chunk_index = 0").select(*key, F.lit(0).alias("now"), F.lit(1).alias("before"))
    )
    # One grouping finds both differences, and puts null paths together.
    counted = sides.groupBy(*key).agg(F.sum("now").alias("now"), F.sum("before").alias("before")).where("now <> before")
    both = F.array(
        F.struct(F.lit("gone").alias("change"), F.col("before").alias("copies")),
        F.struct(F.lit("new").alias("change"), F.col("now").alias("copies")),
    )
    changes = counted.select(*key, F.explode(both).alias("one")).select(*key, "one.copies", "one.change")
    return changes.where("copies > 0")


def refresh_index(
    documents: DataFrame, root: str, model: Model | None = None, store: tuple[str, str] | None = None
) -> DataFrame:
    """Index what is new in documents (source_path, text), drop what is gone, and return the new status row.

    Unchanged documents are neither cut nor embedded again: the changes go to a
    layer of their own, which readers put on top of the ones before. A model
    must be the one the index was built with (``store`` as in ``build_index``); without one, new chunks are
    weighted as when the base was built, until the next ``build_index``. After
    ``MOST_LAYERS`` layers they are merged. Without an index, one is built.
    Documents without changes leave the version as it is. One refresh at a time
    may run; readers go on with the version they began with, and a refresh that
    fails leaves it in place.
    """
    spark = documents.sparkSession
    before = index_status(spark, root).first()
    if before["version"] is None:
        return build_index(documents, root, model, store=store)
    append_status(spark, root, "building")
    try:
        layers = layers_of(spark, root, before["version"])
        chunks = live_table(spark, layers, "chunks")
        changes = kept(document_changes(documents, chunks), "changes")
        if changes.isEmpty():
            append_status(spark, root, "ready", document_count=before["document_count"], version=before["version"])
            return index_status(spark, root)
        version = uuid.uuid4().hex
        layer = Layer(f"{root}/builds/{version}", version, False, True, layers[0].blocks)
        words = _write_layer(documents, chunks, changes, layers, layer, model, store)
        layers = [*layers, replace(layer, words=words)]
        write_layers(spark, root, version, layers)
        if len(layers) >= MOST_LAYERS:
            version = _merge(spark, root, layers)
            layers = layers_of(spark, root, version)
        count = live_table(spark, layers, "chunks").count()
        append_status(spark, root, "ready", document_count=count, version=version)
    except Exception as problem:
        append_status(spark, root, "failed", last_error=str(problem))
        raise
    return index_status(spark, root)


def compact_index(spark: SparkSession, root: str) -> DataFrame:
    """Merge the layers of an index into one, without what is gone; nothing is cut or embedded again. Returns the status row."""
    before = index_status(spark, root).first()
    if before["version"] is None:
        return index_status(spark, root)
    append_status(spark, root, "building")
    try:
        version = _merge(spark, root, layers_of(spark, root, before["version"]))
        append_status(spark, root, "ready", document_count=before["document_count"], version=version)
    except Exception as problem:
        append_status(spark, root, "failed", last_error=str(problem))
        raise
    return index_status(spark, root)


def _write_layer(
    documents: DataFrame, chunks: DataFrame, changes: DataFrame, layers: list[Layer], layer: Layer, model: Model | None,
    store: tuple[str, str] | None,
) -> bool:
    """Write the tables of a layer; whether its chunks have any words."""
    spark = documents.sparkSession
    key = ["source_path", "text_hash"]

    def of(rows: DataFrame, change: str) -> DataFrame:
        """Rows of changed documents; null paths are one path."""
        wanted = changes.where(F.col("change") == change).select(*[F.col(c).alias(f"__{c}") for c in key])
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
        return rows.join(wanted, same, "left_semi")

    of(chunks, "gone").select("id").write.parquet(f"{layer.folder}/gone")
    keyed = documents.select(
        F.col("source_path").cast("string").alias("source_path"), "text", text_hash(F.col("text")).alias("text_hash")
    )
    # Ids go on above all that were ever given out.
    ids = [spark.read.parquet(f"{one.folder}/chunks").agg(F.max("id")).first()[0] or 0 for one in layers]
    write_chunks(of(keyed, "new"), f"{layer.folder}/chunks", max(ids))
    made = spark.read.parquet(f"{layer.folder}/chunks")
    if model is None:
        vectors = TfidfEmbedder.load(f"{layers[0].folder}/embedder").transform(made.select("id", "words"))
    else:
        vectors = embedded(made.select("id", "content"), model, store)
    vectors.select("id", "embedding").write.parquet(f"{layer.folder}/vectors")
    return write_words(made, layer.folder, made.count(), layer.blocks)


def _merge(spark: SparkSession, root: str, layers: list[Layer]) -> str:
    """A new version of one layer that holds what is live in some layers."""
    version = uuid.uuid4().hex
    folder = f"{root}/builds/{version}"
    live_table(spark, layers, "chunks").write.parquet(f"{folder}/chunks")
    live_table(spark, layers, "vectors").write.parquet(f"{folder}/vectors")
    chunks = spark.read.parquet(f"{folder}/chunks")
    words = write_words(chunks, folder, chunks.count(), layers[0].blocks)
    try:
        embedder = TfidfEmbedder.load(f"{layers[0].folder}/embedder")
    except Exception:  # noqa: BLE001 - an index built with a model has none
        embedder = None
    if embedder is not None:
        embedder.save(f"{folder}/embedder")
    write_layers(spark, root, version, [Layer(folder, version, False, False, layers[0].blocks, words)])
    return version
