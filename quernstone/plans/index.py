"""Build a searchable index of documents and search it.

An index is a folder: a status log, and one folder per build with three tables

* ``chunks``: id, text_hash, content, metadata, source_path, chunk_index, words, created_at, updated_at
* ``vectors``: id, embedding
* ``postings``: term, ids, positions, in folders by term and sorted by it, so that a search reads little

A build writes a folder of its own and becomes visible through its ``ready``
entry, so searches never meet a half-built index. ``refresh`` adds folders of
changes, which ``layers`` puts together on reading.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import english_index
from ..operators.chunks import chunk_documents
from ..operators.clusters import write_clusters
from ..operators.embed import TfidfEmbedder, embed_documents
from ..operators.embedding_store import embed_once
from ..operators.fuse import rrf_fuse
from ..operators.keyword import keyword_topk, query_terms, write_postings
from ..operators.keyword_blocks import write_posting_blocks
from ..operators.semantic import semantic_topk
from ..sources.build_log import append_status, index_status
from ..sources.scratch import released
from .layers import Layer, layers_of, live_postings, live_table, probed_table, write_layers

Model = Callable[[list[str]], Sequence[Sequence[float]]]

# Hybrid search takes three times the wanted results from each list.
FETCH_FACTOR = 3
# Chunks are short: so many of them have about half as many words as a share of documents.
SHARE_CHUNKS = 8192
NO_HITS = "rank int, id long, content string, score double, search_type string"


class IndexNotReady(RuntimeError):
    pass


def build_index(
    documents: DataFrame,
    root: str,
    model: Model | None = None,
    cluster_vectors: bool = False,
    query_tables: bool = False,
    store: tuple[str, str] | None = None,
) -> DataFrame:
    """Index documents (source_path, text) under ``root`` and return the new status row.

    Texts are cut and split into index words once; vectors and postings are made
    from the stored chunks, so nothing is computed twice and ids stay what they are.
    Without a model, chunks get hashed TF-IDF vectors whose weights are stored
    with the index. ``cluster_vectors`` adds a copy of the vectors laid out for
    approximate search, and ``query_tables`` one of the postings in blocks for
    searches of a table of queries (``batch``). With ``store``, the folder of an
    embedding store and the model's name, the model gets only texts that the
    store does not have. An empty source leaves the tables of the last build in
    place, and its status keeps the count of what is served (0 if nothing is).
    """
    spark = documents.sparkSession
    append_status(spark, root, "building")
    try:
        if documents.isEmpty():
            served = index_status(spark, root).first()["document_count"]
            append_status(spark, root, "ready", document_count=served)
            return index_status(spark, root)
        version = uuid.uuid4().hex
        folder = f"{root}/builds/{version}"
        write_chunks(documents, f"{folder}/chunks")
        chunks = spark.read.parquet(f"{folder}/chunks")
        n_chunks = chunks.count()
        if model is None:
            embedder = TfidfEmbedder.fit(chunks)
            embedder.save(f"{folder}/embedder")
            vectors = embedder.transform(chunks.select("id", "words"))
        else:
            vectors = embedded(chunks.select("id", "content"), model, store)
        vectors.select("id", "embedding").write.option("compression", "zstd").parquet(f"{folder}/vectors")
        if cluster_vectors:
            write_clusters(spark.read.parquet(f"{folder}/vectors"), f"{folder}/clusters")
        found = write_words(chunks, folder, n_chunks, query_tables)
        write_layers(spark, root, version, [Layer(folder, version, cluster_vectors, False, query_tables, found)])
        append_status(spark, root, "ready", document_count=n_chunks, version=version)
    except Exception as problem:
        append_status(spark, root, "failed", last_error=str(problem))
        raise
    return index_status(spark, root)


def embedded(chunks: DataFrame, model: Model, store: tuple[str, str] | None) -> DataFrame:
    """Chunks with a model's vectors, by way of an embedding store where one is given."""
    return embed_documents(chunks, model) if store is None else embed_once(chunks, model, *store)


def text_hash(text: Column) -> Column:
    """What tells two texts of one path apart."""
    return F.sha2(text, 256)


def write_chunks(documents: DataFrame, path: str, above: int = 0) -> None:
    """Store the chunks of documents with an id, their index words and the time of writing. Ids are greater than ``above``.

    Ids grow with source path and chunk index, so that hits of equal score come
    in the same order from every build. They are not consecutive. Documents are
    put in order of their paths before they are cut: to find the ranges, Spark
    reads them once more, and would otherwise cut them twice.
    """
    ranged = documents.select(F.col("source_path").cast("string").alias("source_path"), "text").repartitionByRange("source_path")
    chunks = chunk_documents(ranged.withColumn("text_hash", text_hash(F.col("text"))), keep=("text_hash",))
    stored = chunks.sortWithinPartitions("source_path", "chunk_index").select(
        (F.monotonically_increasing_id() + above + 1).alias("id"),
        *chunks.columns,
        english_index(F.col("content")).alias("words"),
        F.current_timestamp().alias("created_at"),
        F.current_timestamp().alias("updated_at"),
    )
    with released(documents.sparkSession):
        stored.write.option("compression", "zstd").parquet(path)


def write_words(chunks: DataFrame, folder: str, n_chunks: int, blocks: bool) -> bool:
    """Store the postings of a layer's stored chunks, and in blocks too where wanted; whether there are any."""
    words = chunks.select("id", "words")
    if words.where(F.exists("words", lambda word: word.isNotNull())).isEmpty():
        return False
    # What shuffles more comes first, while less is stored.
    if blocks:
        write_posting_blocks(words, f"{folder}/blocks", n_chunks, SHARE_CHUNKS)
    write_postings(words, f"{folder}/postings", n_chunks)
    return True


def search(
    spark: SparkSession,
    root: str,
    query: str,
    k: int = 10,
    mode: str = "hybrid",
    model: Model | None = None,
    probes: int | None = None,
) -> DataFrame:
    """The ``k`` chunks that answer a query best, by rank.

    ``mode`` is semantic, keyword or hybrid; any other word means hybrid. An
    index built with a model is searched with the same model. With ``probes``,
    an index with clustered vectors is searched approximately. Columns: rank,
    id, content, metadata, score, search_type, and for hybrid the rank and
    score in both lists.
    """
    status = index_status(spark, root).first()
    if status["status"] != "ready":
        raise IndexNotReady(f"the index is not ready, its status is {status['status']}")
    if status["version"] is None:
        return spark.createDataFrame([], NO_HITS)
    layers = layers_of(spark, root, status["version"])

    def by_meaning(n: int) -> DataFrame:
        asked = {"q": embed_query(spark, layers[0].folder, query, model)}
        if probes is not None:
            return semantic_topk(probed_table(spark, layers, asked, probes), asked, n)
        return semantic_topk(live_table(spark, layers, "vectors"), asked, n)

    def by_words(n: int) -> DataFrame:
        terms = query_terms(spark, {"q": query})
        return keyword_topk(live_postings(spark, layers, terms["q"]), terms, n)

    if mode == "semantic":
        found = by_meaning(k)
    elif mode == "keyword":
        found = by_words(k)
    else:
        fetch = FETCH_FACTOR * k
        found = rrf_fuse(by_meaning(fetch), by_words(fetch), k)
    return with_content(found.drop("query"), live_table(spark, layers, "chunks"), mode)


def hybrid_search(
    vectors: DataFrame,
    words: DataFrame,
    query_vector: Sequence[float],
    terms: Sequence[str],
    k: int = 10,
    **weights: float,
) -> DataFrame:
    """Fused hits of one query over a vector table and a postings table that share ids."""
    fetch = FETCH_FACTOR * k
    semantic = semantic_topk(vectors, {"q": query_vector}, fetch)
    keyword = keyword_topk(words, {"q": terms}, fetch)
    return rrf_fuse(semantic, keyword, k, **weights)


def with_content(hits: DataFrame, chunks: DataFrame, search_type: str) -> DataFrame:
    """Add content and metadata to the hits of one query.

    The hits are the ``k`` rows the caller asked for and go to the tasks that scan the chunks.
    """
    filled = chunks.select("id", "content", "metadata").join(F.broadcast(hits), "id")
    filled = filled.withColumn("search_type", F.lit(search_type))
    others = [c for c in hits.columns if c not in ("id", "rank", "score")]
    return filled.select("rank", "id", "content", "metadata", "score", *others, "search_type").orderBy("rank")


def embed_query(spark: SparkSession, folder: str, query: str, model: Model | None) -> list[float]:
    asked = spark.createDataFrame([(query,)], "content string")
    if model is None:
        asked = asked.withColumn("words", english_index(F.col("content")))
        embedded = TfidfEmbedder.load(f"{folder}/embedder").transform(asked)
    else:
        embedded = embed_documents(asked, model)
    return embedded.first()["embedding"]
