"""Searches for a table of queries, and index refreshes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vector import SCORE_DIGITS
from ..operators.embedding_store import embed_once, store_log
from ..operators.keyword_blocks import blocks_read, keyword_topk_of, write_posting_blocks
from ..operators.vector_join import clustered_topk, recall, vector_topk, write_search_clusters
from ..plans.batch import search_table
from ..plans.index import build_index, search
from ..plans.layers import layers_of, live_table
from ..plans.refresh import document_changes, refresh_index
from ..sources.build_log import index_status
from ..sources.scratch import scratch_path
from .search import (
    CHUNK_ROWS,
    CHUNKS,
    COSINE,
    QUERY_WORDS,
    _fuse_sql,
    _letter_counts,
    _postings,
    _postings_sql,
    _rounded,
    _scores_sql,
    articles,
)
from .search import ORACLES as SEARCH_ORACLES
from .tables import read, read_spread

#: Every row whose id this divides is a query.
ONE_IN = 100
NEAREST, BEST = 10, 20
#: A document as a query: its most frequent index words.
QUERY_TERMS = 2


def _vectors(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors, vectors.where(F.col("id") % ONE_IN == 0).withColumnRenamed("id", "query")


def _exact(spark, sf_dir):
    vectors, queries = _vectors(spark, sf_dir)
    return vector_topk(queries, vectors, NEAREST)


def _clustered(spark, sf_dir):
    vectors, queries = _vectors(spark, sf_dir)
    folder = scratch_path(spark, "clusters")
    write_search_clusters(vectors, folder)
    return clustered_topk(spark, folder, queries, NEAREST)


def _recall(spark, sf_dir):
    """Over all queries: how many hits there are, and whether nine tenths of them are found in the clusters that are probed."""
    found = recall(_clustered(spark, sf_dir), _exact(spark, sf_dir))
    return found.agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("wanted").alias("n_wanted"),
        (F.sum("found") >= 0.9 * F.sum("wanted")).alias("nine_tenths_found"),
    )


def _blocks(spark, sf_dir):
    """The postings of all documents in blocks, and the terms of the queries."""
    folder = scratch_path(spark, "blocks")
    words = _postings(spark, sf_dir)
    write_posting_blocks(words, folder, read(spark, sf_dir, "documents").count())
    stored = spark.read.parquet(folder)
    texts = stored.select("term", F.explode("texts").alias("text"))
    counts = texts.where(F.col("text.id") % ONE_IN == 0).select(
        F.col("text.id").alias("query"), "term", F.size("text.positions").alias("n")
    )
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "term"))
    return stored, counts.withColumn("rank", rank).where(F.col("rank") <= QUERY_TERMS).select("query", "term")


def _keyword(spark, sf_dir):
    return keyword_topk_of(*_blocks(spark, sf_dir), BEST)


def _reading(spark, sf_dir):
    """Of each query: the postings of its terms, and whether those in blocks with all terms, and of these the scored ones, are no more."""
    read_of = blocks_read(*_blocks(spark, sf_dir), BEST)
    within = (F.col("read") <= F.col("in_blocks")) & (F.col("in_blocks") <= F.col("postings"))
    return read_of.select("query", "postings", within.alias("within"))


def _earlier(now):
    """The articles as they once were: the French ones are missing, the English ones lack their headings, others lay elsewhere."""
    path = F.when(F.col("source_path").startswith("kb/es/"), F.regexp_replace("source_path", "^kb/", "old/"))
    return now.where(~F.col("source_path").startswith("kb/fr/")).select(
        F.coalesce(path, "source_path").alias("source_path"), F.regexp_replace("text", r"^# About .*\n\n", "").alias("text")
    )


def _refreshed(spark, sf_dir):
    now = articles(spark, sf_dir)
    root = scratch_path(spark, "index")
    build_index(_earlier(now), root, _letter_counts)
    status = refresh_index(now, root, _letter_counts).first()
    chunks = live_table(spark, layers_of(spark, root, status["version"]), "chunks")
    return chunks.select(
        "source_path", "chunk_index", "content", F.col("metadata.title").alias("title"),
        F.col("metadata.total_chunks").alias("total_chunks"),
    )


def _changes(spark, sf_dir):
    now = articles(spark, sf_dir)
    root = scratch_path(spark, "index")
    version = build_index(_earlier(now), root, _letter_counts).first()["version"]
    changes = document_changes(now, live_table(spark, layers_of(spark, root, version), "chunks"))
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").cast("long").alias("copies"))


def _search_table(mode):
    def found(spark, sf_dir):
        now = articles(spark, sf_dir)
        root = scratch_path(spark, "index")
        build_index(now, root, _letter_counts, query_tables=True)
        queries = now.withColumn("query", F.regexp_extract("source_path", r"(\d+)\.md$", 1).cast("long"))
        # The last words of a document's text are its question.
        words = F.slice(F.split(F.trim("text"), r"\s+"), -3, 3)
        queries = queries.where(F.col("query") % ONE_IN == 0).select("query", F.array_join(words, " ").alias("text"))
        hits = search_table(spark, root, queries, BEST, mode, _letter_counts)
        others = [c for c in hits.columns if c not in ("id", "metadata", "content", "search_type")]
        return _rounded(hits.select(*others, "metadata.source_file", "metadata.chunk_index"))

    return found


def _stored_embeddings(spark, sf_dir):
    """A store after two calls: for the English documents, then for all of them."""
    documents = read_spread(spark, sf_dir, "documents", "doc_id", "lang", "text")
    store = scratch_path(spark, "embeddings")
    embed_once(documents.where("lang = 'en'"), _letter_counts, store, "letters", "text")
    return embed_once(documents, _letter_counts, store, "letters", "text"), store


def _embed_once(spark, sf_dir):
    made, _ = _stored_embeddings(spark, sf_dir)
    return made.select("doc_id", *(F.get("embedding", F.lit(k)).alias(letter) for k, letter in enumerate("aeio")))


def _embedding_calls(spark, sf_dir):
    """How many texts each call had to give to the model."""
    _, store = _stored_embeddings(spark, sf_dir)
    place = F.row_number().over(Window.orderBy("at"))
    return store_log(spark, store).select(place.alias("call"), "n_texts")


def _search_with_model(mode):
    """One search of an index whose vectors SQL can state."""

    def found(spark, sf_dir):
        root = scratch_path(spark, "index")
        build_index(articles(spark, sf_dir), root, _letter_counts)
        hits = search(spark, root, QUERY_WORDS["two"], BEST, mode, _letter_counts)
        others = [c for c in hits.columns if c not in ("id", "metadata", "content", "search_type")]
        return _rounded(hits.select(*others, "metadata.source_file", "metadata.chunk_index"))

    return found


QUERIES = {
    "vector_table_topk": _exact,
    "vector_table_clusters": _clustered,
    "vector_table_recall": _recall,
    "keyword_table_topk": _keyword,
    "keyword_table_reading": _reading,
    "refresh_index": _refreshed,
    "refresh_changes": _changes,
    "search_table_semantic": _search_table("semantic"),
    "search_model_semantic": _search_with_model("semantic"),
    "search_model_hybrid": _search_with_model("hybrid"),
    "embed_once": _embed_once,
    "embedding_calls": _embedding_calls,
}

_ASKED = f"""counts AS MATERIALIZED (SELECT id, term, count(*) AS n FROM postings GROUP BY id, term),
terms AS (
  SELECT id AS query, term FROM counts WHERE id % {ONE_IN} = 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, term) <= {QUERY_TERMS})"""

ORACLES = {
    "vector_table_topk": f"""SELECT query, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM (
    SELECT q.vec_id AS query, e.vec_id AS id, {COSINE.format('e.embedding', 'q.embedding::DOUBLE[]')} AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % {ONE_IN} = 0))
WHERE rank <= {NEAREST}""",
    "vector_table_recall": f"""SELECT count(*) AS n_queries,
  (count(*) * least({NEAREST}, (SELECT count(*) FROM embeddings)))::BIGINT AS n_wanted, TRUE AS nine_tenths_found
FROM embeddings WHERE vec_id % {ONE_IN} = 0""",
    # Each query has at most two terms: a cover is an occurrence of one term, or neighbouring ones of two terms.
    "keyword_table_topk": f"""WITH {_postings_sql('documents', 'doc_id', 'text')}, {_ASKED},
wanted AS (SELECT query, count(*) AS n FROM terms GROUP BY query),
hits AS MATERIALIZED (SELECT t.query, p.id, p.term, p.pos FROM postings p JOIN terms t USING (term)),
neighbours AS (
  SELECT h.query, h.id, w.n, h.term, h.pos, lead(h.term) OVER o AS next_term, lead(h.pos) OVER o AS next_pos
  FROM hits h JOIN wanted w ON h.query = w.query WINDOW o AS (PARTITION BY h.query, h.id ORDER BY h.pos)),
covers AS (
  SELECT query, id, 1 AS words FROM neighbours WHERE n = 1
  UNION ALL SELECT query, id, next_pos - pos FROM neighbours WHERE n = 2 AND next_term <> term),
scores AS (SELECT query, id, round(sum(0.1::DOUBLE / words), {SCORE_DIGITS}) AS score FROM covers GROUP BY query, id)
SELECT query, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM scores) WHERE rank <= {BEST}""",
    "keyword_table_reading": f"""WITH {_postings_sql('documents', 'doc_id', 'text')}, {_ASKED}
SELECT t.query, sum(c.n)::BIGINT AS postings, TRUE AS within FROM terms t JOIN counts c USING (term) GROUP BY t.query""",
    "refresh_index": CHUNK_ROWS,
    "refresh_changes": """SELECT 'new' AS change, count(*) AS documents, count(*) AS copies FROM documents WHERE lang IN ('en', 'fr', 'es')
UNION ALL SELECT 'gone', count(*), count(*) FROM documents WHERE lang IN ('en', 'es')""",
    "embed_once": SEARCH_ORACLES["embed_with_model"],
    "embedding_calls": """WITH firsts AS (SELECT text, bool_or(lang = 'en') AS early FROM documents GROUP BY text)
SELECT 1::INTEGER AS call, count(*) FILTER (early) AS n_texts FROM firsts
UNION ALL SELECT 2, count(*) FILTER (NOT early) FROM firsts""",
}
_COUNTED = ", ".join(f"1.0::DOUBLE + length({{0}}) - length(replace({{0}}, '{c}', ''))" for c in "aeio")
_UNIT = "list_transform({0}, lambda x: (x / sqrt(list_dot_product({0}, {0})))::FLOAT)"
ORACLES["search_table_semantic"] = rf"""WITH RECURSIVE {CHUNKS},
numbered AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY source_path, chunk_index) AS id, source_path, chunk_index,
         [{_COUNTED.format('content')}] AS v FROM chunks),
stored AS MATERIALIZED (SELECT id, source_path, chunk_index, {_UNIT.format('v')} AS v FROM numbered),
words AS (
  SELECT regexp_extract(source_path, '(\d+)\.md$', 1)::BIGINT AS query, regexp_split_to_array(trim(text, ' '), '[ \t\n\x0B\f\r]+') AS w
  FROM articles),
asked AS (SELECT query, array_to_string(w[-3:], ' ') AS text FROM words WHERE query % {ONE_IN} = 0),
vectors AS (SELECT query, [{_COUNTED.format('text')}] AS v FROM asked),
scored AS (
  SELECT q.query, s.source_path AS source_file, s.chunk_index, s.id,
         {COSINE.format('s.v', _UNIT.format('q.v') + '::DOUBLE[]')} AS score FROM vectors q, stored s)
SELECT query, rank, score, source_file, chunk_index FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM scored) WHERE rank <= {BEST}"""
_NUMBERED = f"""{CHUNKS},
numbered AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY source_path, chunk_index) AS id, source_path, chunk_index, content,
         [{_COUNTED.format('content')}] AS v FROM chunks),
asked_vector AS (SELECT [{_COUNTED.format('text')}] AS v FROM (SELECT '{QUERY_WORDS["two"]}' AS text)),
near AS (
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank
  FROM (SELECT n.id, {COSINE.format(_UNIT.format('n.v'), _UNIT.format('q.v') + '::DOUBLE[]')} AS score
        FROM numbered n, asked_vector q))"""
ORACLES["search_model_semantic"] = f"""WITH RECURSIVE {_NUMBERED}
SELECT r.rank, r.score, n.source_path AS source_file, n.chunk_index FROM near r JOIN numbered n USING (id)
WHERE r.rank <= {BEST}"""
_FUSED = _fuse_sql(
    f"SELECT 'two' AS query, * FROM near WHERE rank <= {3 * BEST}",
    f"SELECT query, id, score, rank FROM ranked WHERE rank <= {3 * BEST}", "query", BEST,
)
ORACLES["search_model_hybrid"] = f"""WITH RECURSIVE {_NUMBERED},
{_scores_sql(['two'], 'numbered', 'id', 'content')}
SELECT f.rank, f.score, f.semantic_rank, f.semantic_score, f.keyword_rank, f.keyword_score,
       n.source_path AS source_file, n.chunk_index
FROM ({_FUSED}) f JOIN numbered n USING (id)"""
