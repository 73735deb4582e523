"""Search an index for a table of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import english_index
from ..operators.embed import TfidfEmbedder, embed_documents
from ..operators.fuse import rrf_fuse
from ..operators.keyword_blocks import keyword_topk_of, terms_of
from ..operators.vector_join import vector_topk
from ..sources.build_log import index_status
from .index import FETCH_FACTOR, IndexNotReady, Model
from .layers import gone_ids, layers_of, live_table, posting_blocks


def search_table(
    spark: SparkSession, root: str, queries: DataFrame, k: int = 10, mode: str = "hybrid", model: Model | None = None
) -> DataFrame:
    """The ``k`` chunks that answer each query best: the columns of ``index.search`` with ``query`` before them.

    ``queries`` has query (a name, of any type) and text; of repeated names one
    is asked. The queries are never gathered: their vectors meet the stored
    ones in cells, their terms the posting blocks by join. The index must have
    been built with ``query_tables`` for hybrid and keyword searches. Queries
    without index words have semantic hits only; null texts count as empty.
    """
    status = index_status(spark, root).first()
    if status["status"] != "ready" or status["version"] is None:
        raise IndexNotReady(f"the index is not ready, its status is {status['status']}")
    layers = layers_of(spark, root, status["version"])
    asked = queries.select("query", F.coalesce("text", F.lit("")).alias("content")).dropDuplicates(["query"])

    def by_meaning(n: int) -> DataFrame:
        if model is None:
            embedder = TfidfEmbedder.load(f"{layers[0].folder}/embedder")
            vectors = embedder.transform(asked.withColumn("words", english_index(F.col("content"))))
        else:
            vectors = embed_documents(asked, model)
        return vector_topk(vectors, live_table(spark, layers, "vectors"), n)

    def by_words(n: int) -> DataFrame:
        terms = terms_of(asked, "query", "content")
        return keyword_topk_of(posting_blocks(spark, layers), terms, n, gone_ids(spark, layers))

    if mode == "semantic":
        found = by_meaning(k)
    elif mode == "keyword":
        found = by_words(k)
    else:
        found = rrf_fuse(by_meaning(FETCH_FACTOR * k), by_words(FETCH_FACTOR * k), k)
    chunks = live_table(spark, layers, "chunks").select("id", "content", "metadata")
    others = [c for c in found.columns if c not in ("query", "id", "rank", "score")]
    filled = found.join(chunks, "id").withColumn("search_type", F.lit(mode))
    return filled.select("query", "rank", "id", "content", "metadata", "score", *others, "search_type")
