"""Search queries over the documents and embeddings tables, each with its SQL where it has one."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..functions.text import (
    DOUBLED,
    REGION_1,
    REGION_2,
    SHORT_SYLLABLE,
    STEM_FINAL,
    STEM_IRREGULAR,
    STEP_2,
    STEP_3,
    STEP_4,
    STOP_WORDS,
    TOKEN_PATTERN,
    document_title,
    english_index,
    word_tokens,
)
from ..functions.vector import SCORE_DIGITS, cosine_similarity, dot
from ..operators import keyword, semantic
from ..operators.chunks import chunk_documents
from ..operators.clusters import PROBES, cluster_topk, write_clusters
from ..operators.embed import TfidfEmbedder, embed_documents
from ..operators.fuse import rrf_fuse
from ..operators.semantic import rank_hits
from ..plans.index import build_index, hybrid_search, search
from ..sources.build_log import index_status
from ..sources.scratch import scratch_path
from .tables import read, read_spread

# Texts of three callers; the made-up documents hold these words.
QUERY_WORDS = {"two": "thing erin", "one": "tions", "three": "ther and the ones of thea"}


def articles(spark, sf_dir):
    """Documents as named markdown files; the English ones carry a heading."""
    path = F.concat(F.lit("kb/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    heading = F.concat(F.lit("# About "), F.col("source"), F.lit(" no. "), F.col("doc_id").cast("string"), F.lit("\n\n"))
    text = F.when(F.col("lang") == "en", F.concat(heading, "text")).otherwise(F.col("text"))
    documents = read_spread(spark, sf_dir, "documents", "doc_id", "lang", "source", "text")
    return documents.select(path.alias("source_path"), text.alias("text"))


def _chunks(spark, sf_dir):
    return chunk_documents(articles(spark, sf_dir)).select(
        "source_path",
        "chunk_index",
        "content",
        F.col("metadata.title").alias("title"),
        F.col("metadata.total_chunks").alias("total_chunks"),
    )


def _titles(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "source_path", document_title(F.col("text"), F.col("source_path")).alias("title")
    )


def _tokens(spark, sf_dir):
    """Words of every document as the tokenizer sees them: how many, how many different, and the longest."""
    words = read_spread(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", word_tokens(F.col("text")).alias("words")
    )
    lengths = F.transform("words", lambda w: F.length(w))
    return words.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_different"),
        F.array_max(lengths).alias("longest"),
    )


def _postings(spark, sf_dir):
    return keyword.postings(read_spread(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _text_words(spark, sf_dir):
    return keyword.text_words(read_spread(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _query_terms(spark):
    return keyword.query_terms(spark, QUERY_WORDS)


def _keyword_topk(spark, sf_dir):
    return keyword.keyword_topk(*_keyword(["two"])(spark, sf_dir), 20).drop("query")


def _mean_vector(df):
    """Mean of all vectors: one row, whatever the size of the table."""
    each = df.select(F.posexplode("embedding").alias("at", "x")).groupBy("at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return [row["x"] for row in each.orderBy("at").collect()]


def _mean_vectors(df):
    """Mean vector per label: the caller's list of queries, one per label."""
    each = df.select("label", F.posexplode("embedding").alias("at", "x"))
    means = each.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"))
    return {str(r["label"]): [e["x"] for e in r["v"]] for r in rows.collect()}


def _semantic_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return semantic.semantic_topk(vectors, {"mean": _mean_vector(vectors)}, 25, "vec_id").drop("query")


def _semantic_batch(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return semantic.semantic_topk(vectors, _mean_vectors(vectors), 10, "vec_id")


def _semantic_lsh(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    model, hashed = semantic.lsh_index(vectors)
    return semantic.semantic_lsh_topk(model, hashed, _mean_vector(vectors), 10, "vec_id")


def _semantic_clusters(spark, sf_dir):
    """Every cluster is probed, so the answer is that of the exact search."""
    vectors = read(spark, sf_dir, "embeddings")
    folder = scratch_path(spark, "clusters")
    write_clusters(vectors.withColumnRenamed("vec_id", "id"), folder)
    return cluster_topk(spark, folder, {"mean": _mean_vector(vectors)}, 25, probes=None).drop("query")


def _neighbour_similarity(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    score = cosine_similarity(F.col("embedding"), F.col("other"))
    return vectors.join(following, "vec_id").select("vec_id", F.round(score, SCORE_DIGITS).alias("score"))


def _embed(spark, sf_dir):
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    # Kept for the two passes of fitting and transforming, as an index build keeps them.
    folder = scratch_path(spark, "words")
    docs.select("doc_id", english_index(F.col("text")).alias("words")).write.parquet(folder)
    words = spark.read.parquet(folder)
    return TfidfEmbedder.fit(words, dimensions=256).transform(words).select("doc_id", "embedding")


def _letter_counts(texts):
    """A model that SQL can state: how often four letters stand in a text."""
    return [[text.count(letter) + 1.0 for letter in "aeio"] for text in texts]


def _embed_with_model(spark, sf_dir):
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    made = embed_documents(docs, _letter_counts, "text")
    return made.select("doc_id", *(F.get("embedding", F.lit(k)).alias(letter) for k, letter in enumerate("aeio")))


def _embedding_norms(spark, sf_dir):
    made = _embed(spark, sf_dir)
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return made.select("doc_id", F.size("embedding").alias("dimensions"), F.round(norm, 3).alias("norm"))


def _rrf_fuse(spark, sf_dir):
    """Customers of each nation, fused from their rank by balance and by the sum of their orders."""
    customers = read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("query"), F.col("c_custkey").alias("id"), "c_acctbal"
    )
    spent = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("score")
    )
    by_balance = rank_hits(customers.select("query", "id", F.col("c_acctbal").alias("score")), None, 25)
    by_orders = rank_hits(customers.join(spent, "id").select("query", "id", "score"), None, 25)
    return _rounded(rrf_fuse(by_balance, by_orders, 20))


def _hybrid(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    words, asked = _keyword(["two"])(spark, sf_dir)
    return _rounded(hybrid_search(vectors, words, _mean_vector(vectors), asked["two"], 20)).drop("query")


def _rounded(hits):
    return hits.withColumn("score", F.round("score", 9))


def _state(spark, sf_dir, name):
    """The files of a table with their sizes and times of change: what is built from it holds as long as they do."""
    files = read(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return tuple(sorted(tuple(map(str, row)) for row in files.distinct().collect()))


@cache
def _built(spark, sf_dir, state):
    root = scratch_path(spark, "index")
    build_index(articles(spark, sf_dir), root)
    return root


def _index(spark, sf_dir):
    """An index of all articles, built anew when the table has changed."""
    return _built(spark, sf_dir, _state(spark, sf_dir, "documents"))


@cache
def _written(spark, sf_dir, state):
    folder = scratch_path(spark, "postings")
    documents = read(spark, sf_dir, "documents")
    keyword.write_postings(_text_words(spark, sf_dir), folder, documents.count())
    return folder


def _stored_postings(spark, sf_dir, terms):
    """Stored postings of some terms, written anew when the table has changed."""
    folder = _written(spark, sf_dir, _state(spark, sf_dir, "documents"))
    return keyword.read_postings(spark, folder, terms)


def _keyword(names):
    """Stored postings of the query texts' terms, and the terms."""

    def found(spark, sf_dir):
        asked = {name: _query_terms(spark)[name] for name in names}
        return _stored_postings(spark, sf_dir, {t for terms in asked.values() for t in terms}), asked

    return found


def _keyword_match(spark, sf_dir):
    words, asked = _keyword(["three"])(spark, sf_dir)
    return keyword.keyword_match(words, asked["three"])


def _keyword_batch(spark, sf_dir):
    return keyword.keyword_topk(*_keyword(list(QUERY_WORDS))(spark, sf_dir), 20)


def _cluster_recall(spark, sf_dir):
    """Of every label's mean vector: how many of its 25 nearest are found with a few probes."""
    vectors = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    folder = scratch_path(spark, "clusters")
    write_clusters(vectors, folder)
    asked = _mean_vectors(vectors)
    exact = semantic.semantic_topk(vectors, asked, 25).select("query", "id")
    near = cluster_topk(spark, folder, asked, 25, PROBES).select("query", "id", F.lit(1).alias("found"))
    both = exact.join(near, ["query", "id"], "left")
    return both.groupBy("query").agg(F.count("found").alias("found"), F.count(F.lit(1)).alias("wanted"))


def _built_chunks(spark, sf_dir):
    root = _index(spark, sf_dir)
    version = index_status(spark, root).first()["version"]
    chunks = spark.read.parquet(f"{root}/builds/{version}/chunks")
    return chunks.select(
        "source_path", "chunk_index", "content", F.col("metadata.title").alias("title"),
        F.col("metadata.total_chunks").alias("total_chunks"),
    )


def _search(mode):
    def found(spark, sf_dir):
        hits = search(spark, _index(spark, sf_dir), QUERY_WORDS["two"], 10, mode)
        others = [c for c in hits.columns if c not in ("id", "metadata")]
        return hits.select(*others, "metadata.source_file", "metadata.title", "metadata.chunk_index")

    return found


QUERIES = {
    "document_titles": _titles,
    "chunk_documents": _chunks,
    "tokens": _tokens,
    "postings": _postings,
    "keyword_match": _keyword_match,
    "keyword_topk": _keyword_topk,
    "keyword_batch_topk": _keyword_batch,
    "vector_similarity": _neighbour_similarity,
    "semantic_topk": _semantic_topk,
    "semantic_batch_topk": _semantic_batch,
    "semantic_lsh": _semantic_lsh,
    "semantic_clusters": _semantic_clusters,
    "cluster_recall": _cluster_recall,
    "embed_documents": _embed,
    "embed_with_model": _embed_with_model,
    "embedding_norms": _embedding_norms,
    "rrf_fuse": _rrf_fuse,
    "hybrid_search": _hybrid,
    "build_index": _built_chunks,
    "index_status": lambda spark, d: index_status(spark, _index(spark, d)).select("status", "document_count"),
    "search_semantic": _search("semantic"),
    "search_keyword": _search("keyword"),
    "search_hybrid": _search("hybrid"),
    "search_keyword_scores": lambda spark, d: _search("keyword")(spark, d).select("rank", "score"),
}


ARTICLES = """articles AS (
  SELECT 'kb/' || lang || '/' || doc_id || '.md' AS source_path,
         CASE WHEN lang = 'en' THEN '# About ' || source || ' no. ' || doc_id || chr(10) || chr(10) || text ELSE text END
           AS text
  FROM documents)"""
TITLE = r"coalesce(nullif(regexp_extract(text, '(?m)^#\s+(.+)$', 1), ''), split_part(source_path, '/', -1))"
# What Python's strip() takes for blank.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CUT = r"""CASE WHEN start + 1000 >= length(text) THEN length(text)
  WHEN regexp_matches(substr(text, start + 802, 199), '(?s)(\n|[.!?] )')
  THEN start + 801 + length(regexp_extract(substr(text, start + 802, 199), '(?s)^(.*)(\n|[.!?] )', 1)) + 1
  ELSE start + 1000 END"""
CHUNKS = f"""{ARTICLES},
spans AS (
  SELECT source_path, text, 0 AS start, {CUT.replace('start', '0')} AS stop FROM articles
  UNION ALL
  SELECT source_path, text, start, {CUT} FROM (
    SELECT source_path, text, stop - 100 AS start FROM spans WHERE start + 1000 < length(text))),
pieces AS (
  SELECT source_path, text, start,
         CASE WHEN length(text) <= 1000 THEN text
              ELSE regexp_replace(substr(text, start + 1, stop - start), '^{BLANK}+|{BLANK}+$', '', 'g') END AS content
  FROM spans),
chunks AS (
  SELECT source_path, {TITLE} AS title, content,
         (row_number() OVER (PARTITION BY source_path ORDER BY start) - 1)::INTEGER AS chunk_index,
         (count(*) OVER (PARTITION BY source_path))::INTEGER AS total_chunks
  FROM pieces WHERE content <> '' OR length(text) <= 1000)"""
CHUNK_ROWS = f"WITH RECURSIVE {CHUNKS} SELECT source_path, chunk_index, content, title, total_chunks FROM chunks"


def _suffixes(rules, region: str, special: str = "") -> str:
    cases = []
    for suffix, replacement, before in rules:
        n = len(suffix)
        allowed = f"length(w) - {n} >= {'r2' if suffix == special else region}"
        if before:
            allowed += f" AND substr(w, length(w) - {n}, 1) IN ({', '.join(repr(x) for x in before)})"
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {allowed} THEN w[:-{n + 1}] || '{replacement}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def stem_sql(words: str) -> str:
    """CTEs from a table of distinct lower-cased words to ``stems(word, stem)``."""
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STEM_IRREGULAR.items())
    keep = ", ".join(f"'{x}'" for x in STEM_FINAL)
    doubled = ", ".join(f"'{x}'" for x in DOUBLED)
    steps = [
        # 1a
        """CASE WHEN ends_with(w, 'sses') THEN w[:-3]
           WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
           WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w
           WHEN ends_with(w, 's') AND regexp_matches(w[:-3], '[aeiouy]') THEN w[:-2] ELSE w END""",
        # 1b
        f"""CASE WHEN e = '' THEN w
           WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END
           WHEN NOT regexp_matches(b, '[aeiouy]') THEN w
           WHEN ends_with(b, 'at') OR ends_with(b, 'bl') OR ends_with(b, 'iz') THEN b || 'e'
           WHEN length(b) > 1 AND right(b, 2) IN ({doubled}) THEN b[:-2]
           WHEN length(b) <= r1 AND regexp_matches(b, '{SHORT_SYLLABLE}') THEN b || 'e' ELSE b END""",
        # 1c
        r"regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\1i')",
        _suffixes(STEP_2, "r1"),
        _suffixes(STEP_3, "r1", "ative"),
        _suffixes(STEP_4, "r2"),
        f"""CASE WHEN ends_with(w, 'e') THEN
               CASE WHEN length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(w[:-2], '{SHORT_SYLLABLE}'))
                    THEN w[:-2] ELSE w END
           WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN w[:-2] ELSE w END""",
    ]
    ctes = [
        f"""s0 AS MATERIALIZED (
  SELECT word, (length(word) <= 2 OR regexp_matches(word, '\\p{{N}}')) AS fin,
         regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {words}),
s1 AS MATERIALIZED (SELECT *, length(regexp_extract(w, '^{REGION_1}', 1)) AS a FROM s0),
s2 AS MATERIALIZED (SELECT word, fin, w, CASE WHEN a = 0 THEN length(w) ELSE a END AS r1 FROM s1),
s3 AS MATERIALIZED (SELECT *, length(regexp_extract(substr(w, r1 + 1), '^{REGION_2}', 1)) AS a FROM s2),
t0 AS MATERIALIZED (
  SELECT word, fin, w, r1, CASE WHEN a = 0 THEN length(w) ELSE r1 + a END AS r2 FROM s3)"""
    ]
    for i, step in enumerate(steps):
        extra = "fin" if i else f"fin OR ({step}) IN ({keep}) AS fin"
        if i == 1:
            ending = "regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$', 1)"
            source = f"(SELECT *, {ending} AS e, w[:-length({ending}) - 1] AS b FROM t1)"
        else:
            source = f"t{i}"
        ctes.append(
            f"t{i + 1} AS MATERIALIZED (SELECT word, {extra}, CASE WHEN fin THEN w ELSE {step} END AS w, r1, r2"
            f" FROM {source})"
        )
    ctes.append(
        f"""stems AS MATERIALIZED (
  SELECT word, CASE WHEN length(word) <= 2 OR regexp_matches(word, '\\p{{N}}') THEN word
    ELSE CASE word {irregular} ELSE replace(w, 'Y', 'y') END END AS stem FROM t{len(steps)})"""
    )
    return ",\n".join(ctes)


STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _postings_sql(table: str, key: str, text: str) -> str:
    return f"""words AS MATERIALIZED (
  SELECT {key} AS id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS pos
  FROM (SELECT {key}, regexp_extract_all(lower({text}), '{TOKEN_PATTERN}') AS l FROM {table})),
vocabulary AS MATERIALIZED (SELECT DISTINCT word FROM words WHERE word NOT IN ({STOPS})),
{stem_sql('vocabulary')},
postings AS MATERIALIZED (SELECT id, stem AS term, pos::INTEGER AS pos FROM words JOIN stems USING (word))"""


def _asked_sql(names) -> str:
    """terms(query, term) of the query texts, by the postings' rules; the words are plain and need only stems."""
    rows = ", ".join(f"('{q}', '{QUERY_WORDS[q]}')" for q in names)
    return f"""asked(query, text) AS (VALUES {rows}),
asked_words AS (SELECT DISTINCT query, unnest(regexp_extract_all(lower(text), '{TOKEN_PATTERN}')) AS word FROM asked),
extra AS (SELECT DISTINCT word FROM asked_words WHERE word NOT IN ({STOPS}))"""


def _terms_sql() -> str:
    return "terms AS (SELECT DISTINCT query, stem AS term FROM asked_words JOIN stems USING (word))"


def _scores_sql(names, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Cover density by its definition: for each end the latest start, for each start the earliest end."""
    source = _postings_sql(table, key, text).replace(
        f"SELECT DISTINCT word FROM words WHERE word NOT IN ({STOPS})",
        f"SELECT DISTINCT word FROM words WHERE word NOT IN ({STOPS}) UNION SELECT word FROM extra",
    )
    return f"""{_asked_sql(names)}, {source}, {_terms_sql()},
wanted AS (SELECT query, count(*) AS n FROM terms GROUP BY query),
hits AS MATERIALIZED (SELECT t.query, p.id, p.term, p.pos FROM postings p JOIN terms t USING (term)),
latest AS (
  SELECT e.query, e.id, e.pos AS stop, o.term, max(o.pos) AS pos
  FROM hits e JOIN hits o ON o.query = e.query AND o.id = e.id AND o.pos <= e.pos GROUP BY ALL),
starts AS (SELECT query, id, stop, min(pos) AS start, count(*) AS n FROM latest GROUP BY ALL),
covers AS (
  SELECT s.query, s.id, s.start, min(s.stop) AS stop FROM starts s JOIN wanted w ON w.query = s.query AND w.n = s.n
  GROUP BY ALL),
filled AS (
  SELECT c.query, c.id, c.start, c.stop, count(*) AS inside
  FROM covers c JOIN hits h ON h.query = c.query AND h.id = c.id AND h.pos BETWEEN c.start AND c.stop GROUP BY ALL),
scores AS (
  SELECT query, id, round(sum(0.1 / (1 + (stop - start + 1) - inside)), {SCORE_DIGITS}) AS score
  FROM filled GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM scores)"""


MEAN_VECTOR = """dims AS (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings),
mean AS (SELECT list(x ORDER BY dim) AS v FROM (SELECT dim, avg(x::DOUBLE) AS x FROM dims GROUP BY dim))"""
MEAN_VECTORS = """dims AS (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings),
means AS (
  SELECT label, list(x ORDER BY dim) AS v FROM (SELECT label, dim, avg(x::DOUBLE) AS x FROM dims GROUP BY ALL)
  GROUP BY label)"""
COSINE = f"round(list_cosine_similarity({{}}::DOUBLE[], {{}}), {SCORE_DIGITS})"
SEMANTIC_RANKED = f"""{MEAN_VECTOR},
near AS (
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank
  FROM (SELECT vec_id AS id, {COSINE.format('embedding', 'v')} AS score FROM embeddings, mean))"""


def _fuse_sql(semantic_hits: str, keyword_hits: str, key: str, k: int) -> str:
    both = f"""SELECT {key}, id, s.score AS semantic_score, s.rank AS semantic_rank, w.score AS keyword_score,
      w.rank AS keyword_rank, coalesce(0.7::DOUBLE / (60 + s.rank), 0) + coalesce(0.3::DOUBLE / (60 + w.rank), 0) AS score
    FROM ({semantic_hits}) s FULL JOIN ({keyword_hits}) w USING ({key}, id)"""
    return f"""SELECT {key}, id, round(score, 9) AS score, semantic_rank, keyword_rank, semantic_score, keyword_score, rank
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, semantic_rank NULLS LAST,
             keyword_rank NULLS LAST, id)::INTEGER AS rank FROM ({both})) WHERE rank <= {k}"""


_CUSTOMER_RANKS = """balance AS (
  SELECT c_nationkey::VARCHAR AS query, c_custkey AS id, c_acctbal AS score,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer),
spent AS (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY 1),
by_orders AS (
  SELECT b.query, id, s.score,
         row_number() OVER (PARTITION BY b.query ORDER BY s.score DESC, id)::INTEGER AS rank
  FROM balance b JOIN spent s USING (id))"""

ORACLES = {
    "document_titles": f"WITH {ARTICLES} SELECT source_path, {TITLE} AS title FROM articles",
    "chunk_documents": CHUNK_ROWS,
    "tokens": f"""WITH listed AS (
  SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_PATTERN}') AS words FROM documents)
SELECT doc_id, len(words)::INTEGER AS n_words, len(list_distinct(words))::INTEGER AS n_different,
       list_max(list_transform(words, lambda w: length(w)))::INTEGER AS longest FROM listed""",
    "postings": f"WITH {_postings_sql('documents', 'doc_id', 'text')} SELECT id, term, pos FROM postings",
    "keyword_match": f"""WITH {_scores_sql(['three'])}
SELECT id FROM hits GROUP BY id HAVING count(DISTINCT term) = (SELECT n FROM wanted)""",
    "keyword_topk": f"WITH {_scores_sql(['two'])} SELECT id, score, rank FROM ranked WHERE rank <= 20",
    "keyword_batch_topk": f"WITH {_scores_sql(QUERY_WORDS)} SELECT query, id, score, rank FROM ranked WHERE rank <= 20",
    "vector_similarity": f"""SELECT a.vec_id, {COSINE.format('a.embedding', 'b.embedding::DOUBLE[]')} AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "semantic_topk": f"WITH {SEMANTIC_RANKED} SELECT id, score, rank FROM near WHERE rank <= 25",
    "semantic_clusters": f"WITH {SEMANTIC_RANKED} SELECT id, score, rank FROM near WHERE rank <= 25",
    "semantic_batch_topk": f"""WITH {MEAN_VECTORS},
near AS (
  SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank
  FROM (SELECT m.label::VARCHAR AS query, vec_id AS id, {COSINE.format('embedding', 'v')} AS score
        FROM embeddings, means m))
SELECT query, id, score, rank FROM near WHERE rank <= 10""",
    "rrf_fuse": f"""WITH {_CUSTOMER_RANKS}
{_fuse_sql('SELECT * FROM balance', 'SELECT * FROM by_orders', 'query', 20)}""",
    "hybrid_search": f"""WITH {_scores_sql(['two'])}, {SEMANTIC_RANKED}
SELECT * EXCLUDE (query) FROM (
{_fuse_sql("SELECT 'two' AS query, * FROM near WHERE rank <= 60",
           'SELECT query, id, score, rank FROM ranked WHERE rank <= 60', 'query', 20)})""",
    "embed_with_model": """WITH counts AS (
  SELECT doc_id, 1.0::DOUBLE + length(text) - length(replace(text, 'a', '')) AS a,
         1.0::DOUBLE + length(text) - length(replace(text, 'e', '')) AS e,
         1.0::DOUBLE + length(text) - length(replace(text, 'i', '')) AS i,
         1.0::DOUBLE + length(text) - length(replace(text, 'o', '')) AS o FROM documents),
sized AS (SELECT *, sqrt(a * a + e * e + i * i + o * o) AS norm FROM counts)
SELECT doc_id, (a / norm)::FLOAT AS a, (e / norm)::FLOAT AS e, (i / norm)::FLOAT AS i, (o / norm)::FLOAT AS o
FROM sized""",
    "embedding_norms": f"""WITH indexed AS (
  SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '{TOKEN_PATTERN}'), lambda w: w NOT IN ({STOPS}))) AS n
  FROM documents)
SELECT doc_id, 256 AS dimensions, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS norm FROM indexed""",
    "build_index": CHUNK_ROWS,
    "search_keyword": f"""WITH RECURSIVE {CHUNKS},
numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY source_path, chunk_index) AS id, * FROM chunks),
{_scores_sql(['two'], 'numbered', 'id', 'content')}
SELECT r.rank, n.content, r.score, 'keyword' AS search_type, n.source_path AS source_file, n.title, n.chunk_index
FROM ranked r JOIN numbered n USING (id) WHERE r.rank <= 10""",
    "search_keyword_scores": f"""WITH RECURSIVE {CHUNKS},
numbered AS MATERIALIZED (SELECT row_number() OVER () AS id, content FROM chunks),
{_scores_sql(['two'], 'numbered', 'id', 'content')}
SELECT rank, score FROM ranked WHERE rank <= 10""",
    "index_status": f"WITH RECURSIVE {CHUNKS} SELECT 'ready' AS status, count(*) AS document_count FROM chunks",
}
