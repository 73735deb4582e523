import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions.text import english_index
from quernstone.functions.vector import cosine_similarity
from quernstone.operators import clusters, keyword, semantic
from quernstone.operators.embed import TfidfEmbedder, embed_documents
from quernstone.operators.fuse import rrf_fuse


def covers(tokens, terms):
    """Score by brute force: every span holding all terms that holds no shorter such span."""
    spans = [
        (a, b)
        for a in range(len(tokens))
        for b in range(a, len(tokens))
        if set(terms) <= set(tokens[a : b + 1])
    ]
    shortest = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return sum(0.1 / (1 + sum(t not in terms for t in tokens[a : b + 1])) for a, b in shortest)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.lists(st.sampled_from("abcxy"), max_size=14), min_size=1, max_size=12),
    st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), min_size=1, max_size=3),
)
def test_cover_density_equals_brute_force(spark, texts, queries):
    rows = [(i, term, p + 1) for i, text in enumerate(texts) for p, term in enumerate(text)]
    words = spark.createDataFrame(rows, "id int, term string, pos int")
    asked = {str(n): terms for n, terms in enumerate(queries)}
    got = {(r["query"], r["id"]): r["score"] for r in keyword.cover_density(words, asked).collect()}
    want = {}
    for name, terms in asked.items():
        for i, text in enumerate(texts):
            score = covers(text, terms)
            if score:
                want[name, i] = score
    assert got.keys() == want.keys()
    assert all(math.isclose(got[key], want[key], abs_tol=2e-6) for key in want)


def test_keyword_match_and_topk(spark):
    df = spark.createDataFrame(
        [(1, "Running dogs and a cat"), (2, "a dog ran; the dog sat"), (3, "cats run"), (4, None)], "id int, content string"
    )
    words = keyword.postings(df)
    terms = keyword.query_terms(spark, {"a": "the running DOGS dog", "b": "of the", "c": "dog"})
    assert terms == {"a": ["run", "dog"], "b": [], "c": ["dog"]}
    assert [r["id"] for r in keyword.keyword_match(words, terms["a"]).collect()] == [1]
    assert keyword.keyword_match(words, terms["b"]).count() == 0
    top = keyword.keyword_topk(words, {"c": terms["c"]}, 5).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in top] == [(2, 0.2), (1, 0.1)]
    batch = keyword.keyword_topk(words, terms, 1).orderBy("query").collect()
    assert [(r["query"], r["id"], r["rank"]) for r in batch] == [("a", 1, 1), ("c", 2, 1)]
    assert keyword.keyword_topk(words, {"b": []}, 5).count() == 0


def test_a_term_in_every_text(spark):
    words = spark.range(5000).select(F.col("id"), F.lit("hot").alias("term"), F.lit(1).alias("pos"))
    words = words.unionByName(spark.createDataFrame([(4321, "rare", 3)], "id long, term string, pos int"))
    top = keyword.keyword_topk(words, {"q": ["hot", "rare"]}, 10).collect()
    assert [(r["id"], r["score"]) for r in top] == [(4321, 0.05)]
    assert keyword.cover_density(words, {"q": ["hot"]}).count() == 5000


def test_stored_postings(spark, tmp_path):
    df = spark.range(300).select("id", F.concat(F.lit("word"), F.col("id") % 7, F.lit(" common")).alias("content"))
    words = keyword.postings(df)
    keyword.write_postings(words, str(tmp_path / "p"), 300_000)
    stored = keyword.read_postings(spark, str(tmp_path / "p"), ["common", "word3"])
    assert sorted(stored.collect()) == sorted(words.where("term in ('common', 'word3')").collect())
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_a_hot_term_is_written_by_several_tasks(spark, tmp_path):
    term = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id")))
    words = spark.range(0, 300_000, 1, 8).select("id", term.alias("term"), F.lit(1).alias("pos"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        keyword.write_postings(words, str(tmp_path / "p"), 400_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    hot = keyword.read_postings(spark, str(tmp_path / "p"), ["hot"])
    assert hot.count() == 100_000
    assert len(hot.select(F.input_file_name()).distinct().collect()) > 1


def vectors(spark, n, width, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(width)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3), rows


def exact(rows, query, k):
    q = np.array(query)
    scored = [(-round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 6), i) for i, v in rows]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def test_semantic_equals_brute_force(spark, monkeypatch):
    df, rows = vectors(spark, 400, 8)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    queries = {f"q{n}": rows[n][1] for n in range(5)}
    monkeypatch.setattr(semantic, "BLOCK_ROWS", 16)
    monkeypatch.setattr(semantic, "QUERY_VALUES", 16)  # two queries a pass
    got = semantic.semantic_topk(df, queries, 7).orderBy("query", "rank").collect()
    for name, query in queries.items():
        hits = [(r["id"], r["score"]) for r in got if r["query"] == name]
        assert [h[0] for h in hits] == [e[0] for e in exact(rows, query, 7)]
        assert hits[0][1] == 1.0
    assert [r["rank"] for r in got] == list(range(1, 8)) * 5


def test_equal_vectors_are_ordered_by_id(spark):
    df = spark.range(5000).select("id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    hits = semantic.semantic_topk(df, {"q": [2.0, 4.0]}, 5).orderBy("rank").collect()
    assert [r["id"] for r in hits] == [0, 1, 2, 3, 4]


def test_vectors_without_length_come_last(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [-1.0, 0.0]), (4, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    hits = semantic.semantic_topk(df, {"q": [1.0, 0.0]}, 5).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in hits] == [(4, 0.995037), (3, -1.0), (1, None)]
    with pytest.raises(Exception, match="3 dimensions"):
        semantic.semantic_topk(df, {"q": [1.0, 0.0, 0.0]}, 5).collect()
    with pytest.raises(ValueError):
        semantic.semantic_topk(df, {}, 5)


def test_text_ids(spark):
    df = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [-1.0])], "name string, embedding array<float>")
    hits = semantic.semantic_topk(df, {"q": [1.0], "r": [-1.0]}, 2, "name").orderBy("query", "rank").collect()
    assert [(r["query"], r["id"]) for r in hits] == [("q", "a"), ("q", "b"), ("r", "c"), ("r", "a")]


def test_lsh_recall(spark):
    df, rows = vectors(spark, 600, 8)
    unit = [(i, list(np.array(v) / np.linalg.norm(v))) for i, v in rows]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in unit], "id long, embedding array<float>")
    model, hashed = semantic.lsh_index(df)
    hashed = hashed.cache()
    found = 0
    for n in range(5):
        query = unit[n * 100][1]
        near = semantic.semantic_lsh_topk(model, hashed, query, 10).collect()
        found += len({r["id"] for r in near} & {i for i, _ in exact(unit, query, 10)})
        assert near[0]["score"] == 1.0
    hashed.unpersist()
    assert found >= 45


def test_clusters(spark, tmp_path):
    rng = np.random.default_rng(3)
    towards = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in towards[i % 12] + rng.normal(size=8) * 0.2]) for i in range(900)]
    rows += [(900, [0.0] * 8)]
    df = spark.createDataFrame([*rows, (901, None)], "id long, embedding array<float>")
    path = str(tmp_path / "clusters")
    clusters.write_clusters(df, path, 12)
    stored = spark.read.parquet(f"{path}/vectors")
    assert stored.count() == 901
    queries = {"a": rows[5][1], "b": rows[6][1]}
    everything = clusters.cluster_topk(spark, path, queries, 10, 12).orderBy("query", "rank").collect()
    assert everything == semantic.semantic_topk(df, queries, 10).orderBy("query", "rank").collect()
    few = clusters.cluster_topk(spark, path, {"a": rows[5][1]}, 10, 2)
    assert len({r["id"] for r in few.collect()} & {r["id"] for r in everything if r["query"] == "a"}) >= 9
    assert "PartitionFilters: [cluster" in few._jdf.queryExecution().executedPlan().toString()


def test_cosine_column(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(got[0], 0.96) and got[1] is None


def hits(spark, ids, query="q"):
    rows = [(query, i, 1.0 - n / 10, n + 1) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "query string, id long, score double, rank int")


def test_fusion_puts_what_both_lists_hold_first(spark):
    fused = rrf_fuse(hits(spark, [1, 2]), hits(spark, [2, 3]), None, 0.5, 0.5, 60).orderBy("rank").collect()
    assert [r["id"] for r in fused] == [2, 1, 3]
    assert math.isclose(fused[0]["score"], 0.5 / 62 + 0.5 / 61)
    assert (fused[1]["semantic_rank"], fused[1]["keyword_rank"], fused[1]["keyword_score"]) == (1, None, None)


def test_fusion_keeps_k_and_weights(spark):
    assert rrf_fuse(hits(spark, range(10)), hits(spark, range(5, 15)), 5).count() == 5
    assert rrf_fuse(hits(spark, [1]), hits(spark, [2]), 1, 0.9, 0.1, 60).first()["id"] == 1
    one_side = rrf_fuse(hits(spark, [1]), hits(spark, [])).first()
    assert math.isclose(one_side["score"], 0.7 / 61)
    ties = rrf_fuse(hits(spark, [5, 4]), hits(spark, [3, 2]), None, 0.5, 0.5).orderBy("rank").collect()
    assert [r["id"] for r in ties] == [5, 3, 4, 2]
    with pytest.raises(ValueError):
        rrf_fuse(hits(spark, [1]), hits(spark, [2]), 1, 0.9, 0.3)
    # A weight of zero means the default.
    assert math.isclose(rrf_fuse(hits(spark, []), hits(spark, [2]), 1, 1.0, 0.0).first()["score"], 0.3 / 61)


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "dogs run"), (2, "a dog ran"), (3, "the of"), (4, None)], "id long, content string")
    made = {r["id"]: r["embedding"] for r in embed_documents(df, lambda texts: [[len(t), 1.0] for t in texts]).collect()}
    assert all(math.isclose(np.linalg.norm(v), 1.0, abs_tol=1e-6) for v in made.values())
    assert math.isclose(made[1][0], 8 / math.hypot(8, 1), abs_tol=1e-6)
    indexed = df.withColumn("words", english_index(F.col("content")))
    embedder = TfidfEmbedder.fit(indexed, dimensions=64)
    tfidf = {r["id"]: r["embedding"] for r in embedder.transform(indexed).collect()}
    assert len(tfidf[1]) == 64 and math.isclose(np.linalg.norm(tfidf[1]), 1.0, abs_tol=1e-6)
    assert np.linalg.norm(tfidf[3]) == np.linalg.norm(tfidf[4]) == 0.0
    assert np.dot(tfidf[1], tfidf[2]) > 0


def test_words_meet_by_term_before_they_are_shuffled(spark, tmp_path):
    """A term of many texts is a row per task, from texts as from postings; repeated and missing ids and empty texts included."""
    rows = [(k % 900, "hot the hot word" + str(k % 7)) for k in range(1000)] + [(None, "hot ice"), (5000, None), (5001, "of the")]
    df = spark.createDataFrame(rows, "id long, content string").repartition(3)
    want = sorted(map(str, keyword.postings(df).collect()))
    for name, words in (("rows", keyword.postings(df)), ("texts", keyword.text_words(df))):
        path = str(tmp_path / name)
        keyword.write_postings(words, path, 1000)
        assert sorted(map(str, keyword.read_postings(spark, path).collect())) == want
        assert 1 <= spark.read.parquet(path).where("term = 'hot'").count() <= 3
        assert keyword.read_postings(spark, path, ["hot"]).count() == 2001
    # Postings of an older index, a row per word.
    old = str(tmp_path / "old")
    keyword.postings(df).selectExpr("*", "1 AS n_buckets", "0 AS bucket").write.partitionBy("n_buckets", "bucket").parquet(old)
    assert sorted(map(str, keyword.read_postings(spark, old).collect())) == want
