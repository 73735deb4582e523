"""Searches for a table of queries against brute force, and how much of the stored tables they look at."""

import random
import time
from contextlib import nullcontext
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_search import covers

from quernstone.operators import keyword, keyword_blocks, vector_join
from quernstone.operators.keyword import keyword_topk, postings, text_words
from quernstone.operators.keyword_blocks import blocks_read, keyword_topk_of, terms_of, write_posting_blocks
from quernstone.operators.vector_join import clustered_topk, recall, vector_topk, write_search_clusters
from quernstone.sources.scratch import CLEANUP, size_of

VECTORS = "id long, embedding array<float>"


def made_up(n, width, seed=1, bunches=0):
    """Vectors in all directions, or around some."""
    draw = np.random.default_rng(seed)
    around = draw.normal(size=(bunches, width)) if bunches else np.zeros((1, width))
    rows = around[draw.integers(0, len(around), n)] + draw.normal(size=(n, width)) * (0.3 if bunches else 1)
    return [(k, [float(x) for x in v.astype("f4")]) for k, v in enumerate(rows)]


def nearest(rows, query, k):
    q = np.array(query, "f8")
    with np.errstate(invalid="ignore", divide="ignore"):
        scored = [(float(np.round(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q), 6)), i) for i, v in rows]
    scored = [(-np.inf if np.isnan(s) else s, i) for s, i in scored]
    return [(i, None if np.isneginf(s) else s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]


def by_query(hits):
    out = {}
    for r in hits.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["id"], r["score"]))
    return out


def test_exact_search_equals_brute_force_in_small_cells(spark, monkeypatch):
    # Many cells on both sides, small blocks, and ties among equal vectors.
    monkeypatch.setattr(vector_join, "CELL_VALUES", 8 * 40)
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vector_join, "QUERY_ROWS", 8)
    rows = made_up(300, 8)
    rows += [(1000 + k, rows[5][1]) for k in range(30)] + [(2000, [0.0] * 8)]
    corpus = spark.createDataFrame([*rows, (3000, None)], VECTORS).repartition(3)
    asked = corpus.where("id < 120").withColumn("query", F.concat(F.lit("q"), "id"))
    # A name that is asked twice is one query, one without a vector or a name is none.
    asked = asked.unionByName(asked.where("id = 7")).unionByName(
        spark.createDataFrame([(1, None, "none"), (2, rows[2][1], None)], f"{VECTORS}, query string")
    )
    found = by_query(vector_topk(asked, corpus, 12))
    assert found == {f"q{k}": nearest(rows, rows[k][1], 12) for k in range(120)}


def test_equal_scores_are_merged_no_more_once_no_better_can_come(monkeypatch):
    draw = np.random.default_rng(5)
    # Short vectors so close together that many cosines round to one, as counts of letters are.
    queries, rows = draw.integers(1, 9, (700, 4)).astype("f8"), draw.integers(1, 9, (20_000, 4)).astype("f8")
    asked = pa.RecordBatch.from_arrays(
        [pa.array([0] * 700)] * 3 + [pa.array(range(700)), pa.array([0] * 700), pa.array(queries.tolist())], names=list("abcdef")
    )
    merges = []
    keep = vector_join._BestOfFew.keep
    monkeypatch.setattr(vector_join._BestOfFew, "keep", lambda self, q, *more: (merges.append(len(q)), keep(self, q, *more)))
    best = vector_join._Best([asked], 20)
    best.meet(pa.array(range(20_000)), pa.array(rows.tolist()))
    hits = best.hits().to_pylist()
    for q in (0, 511, 512, 699):
        found = [(r["id"], r["score"]) for r in hits if r["query"] == q]
        assert found == nearest(list(enumerate(rows)), queries[q], 20)
    # Every tie in every block would be more than ten times as many.
    assert sum(merges) < 700 * 20 * 20


def test_vectors_without_length_come_last(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])]
    corpus = spark.createDataFrame(rows, VECTORS)
    found = by_query(vector_topk(corpus.withColumnRenamed("id", "query"), corpus, 5))
    assert found[1] == [(1, 1.0), (3, -1.0), (2, None)]
    assert found[2] == [(1, None), (2, None), (3, None)]
    found = by_query(vector_topk(corpus.withColumnRenamed("id", "query"), corpus, 2))
    assert found == {1: [(1, 1.0), (3, -1.0)], 2: [(1, None), (2, None)], 3: [(3, 1.0), (1, -1.0)]}


def test_no_queries_and_no_vectors(spark):
    none, some = spark.createDataFrame([], VECTORS), spark.createDataFrame(made_up(3, 2), VECTORS)
    assert vector_topk(some.withColumnRenamed("id", "query"), none, 3).count() == 0
    assert vector_topk(none.withColumnRenamed("id", "query"), some, 3).count() == 0


def test_widths_must_agree(spark):
    corpus = spark.createDataFrame([(1, [1.0, 2.0])], VECTORS)
    query = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query long, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        vector_topk(query, corpus, 1).collect()


@pytest.mark.parametrize("bunches", [0, 12])
def test_recall_of_clusters_is_measured_and_reached(spark, tmp_path, bunches):
    rows = made_up(1500, 16, 3, bunches)
    corpus = spark.createDataFrame(rows, VECTORS).repartition(3)
    write_search_clusters(corpus, str(tmp_path / "c"))
    told = spark.read.parquet(str(tmp_path / "c" / "probes")).first()
    assert told["recall"] >= vector_join.WANTED_RECALL
    queries = corpus.where("id % 10 = 3").withColumnRenamed("id", "query")
    near = clustered_topk(spark, str(tmp_path / "c"), queries, 10)
    found = recall(near, vector_topk(queries, corpus, 10)).agg(F.sum("found"), F.sum("wanted")).first()
    assert found[1] == 1500 and found[0] >= 0.9 * found[1]
    if bunches:
        # Where vectors do form clusters, few are needed.
        assert told["probes"] < told["clusters"] / 2
    every = clustered_topk(spark, str(tmp_path / "c"), queries, 10, probes=10_000)
    assert by_query(every) == {k: nearest(rows, rows[k][1], 10) for k in range(3, 1500, 10)}


def test_a_hot_cluster_is_cut_into_shares(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "CELL_VALUES", 4 * 100)
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", 50)
    rows = [(k, [1.0, k / 1000, 0.0, 1.0]) for k in range(900)] + [(k, [-1.0, 0.0, k / 1000, 0.0]) for k in range(900, 1000)]
    stored = spark.createDataFrame(rows, VECTORS).withColumn("cluster", (F.col("id") >= 900).cast("int"))
    asked = stored.where("id % 2 = 0").select("cluster", F.col("id").alias("query"), "embedding")
    hits = vector_join._topk_of_cells(asked, stored, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert by_query(hits.where("query IN (0, 998)")) == {0: nearest(rows[:900], rows[0][1], 3), 998: nearest(rows[900:], rows[998][1], 3)}


def texts_of(seed, n):
    draw = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "other", "thing", "stone", "river"]
    return [(k, " ".join(draw.choice(words) for _ in range(int(draw.paretovariate(0.9) * 3) % 300))) for k in range(n)]


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    rows = texts_of(1, 600) + [(601, None), (602, "")]
    df = spark.createDataFrame(rows, "id long, content string").repartition(3)
    words, path = postings(df), str(tmp_path_factory.mktemp("blocks") / "b")
    patch = pytest.MonkeyPatch()
    patch.setattr(keyword_blocks, "BLOCK_TEXTS", 8)
    write_posting_blocks(words, path, 602)
    patch.undo()
    return rows, words, spark.read.parquet(path)


ASKED = [
    ("one", "alpha"), ("two", "beta GAMMA beta"), ("four", "alpha beta gamma delta"), ("none", "of the"), ("unknown", "alpha zebra"),
    ("null", None), ("one", "alpha"),
]


@pytest.mark.parametrize("k, first", [(1, 1), (5, 2), (20, 8), (1000, 3)])
def test_blocks_give_the_rows_of_the_exhaustive_search(spark, blocks, k, first):
    _, words, stored = blocks
    terms = terms_of(spark.createDataFrame(ASKED, "query string, text string"))
    found = keyword_topk_of(stored, terms, k, first_blocks=first)
    lists = {}
    for r in terms.collect():
        lists.setdefault(r["query"], []).append(r["term"])
    whole = keyword_topk(words, lists, k)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.select(*found.columns).collect()))
    assert {r["query"] for r in found.collect()} == {"one", "two", "four"}


def test_bound_holds_for_every_text(blocks):
    rows, _, _ = blocks
    for terms in (["alpha"], ["alpha", "beta"], ["alpha", "beta", "gamma"]):
        for _, text in rows[:150]:
            tokens = (text or "").split()[:60]
            rarest = min(tokens.count(t) for t in terms)
            assert covers(tokens, terms) <= 0.1 * len(terms) * rarest + 1e-9


def test_blocks_that_cannot_reach_the_best_are_not_scored(spark, blocks):
    _, _, stored = blocks
    terms = terms_of(spark.createDataFrame(ASKED, "query string, text string"))
    read = {r["query"]: r for r in blocks_read(stored, terms, 3, 2).collect()}
    for name in ("one", "two", "four"):
        assert 0 < read[name]["read"] < read[name]["in_blocks"] <= read[name]["postings"]
    assert (read["unknown"]["in_blocks"], read["unknown"]["read"]) == (0, 0) and "none" not in read


def test_queries_of_the_same_terms_are_searched_once(spark, blocks):
    _, _, stored = blocks
    asked = [("a", "alpha beta"), ("b", "beta of alpha"), ("c", "gamma"), ("d", "alpha beta beta")]
    terms = terms_of(spark.createDataFrame(asked, "query string, text string"))
    search = keyword_blocks._Search(stored, terms, 5, None, 2)
    assert {r["query"] for r in search.blocks.select("query").distinct().collect()} == {"a", "c"}
    found = by_query(search.hits())
    assert set(found) == {"a", "b", "c", "d"} and found["a"] == found["b"] == found["d"] != found["c"]
    # Positions are scored where their block lies: none is spread out or handed on per query.
    plan = search.scored(search.open_blocks())._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "positions#" not in plan.replace("texts", "")


def test_ids_taken_away_are_passed_over(spark, blocks):
    _, words, stored = blocks
    terms = terms_of(spark.createDataFrame([("q", "alpha beta")], "query string, text string"))
    best = [r["id"] for r in keyword_topk_of(stored, terms, 9).orderBy("rank").collect()]
    gone = spark.createDataFrame([(i,) for i in best[:4]], "id long")
    left = keyword_topk_of(stored, terms, 5, gone, 1)
    assert [r["id"] for r in left.orderBy("rank").collect()] == best[4:9]


def test_no_texts_and_no_queries(spark, blocks, tmp_path):
    _, words, stored = blocks
    write_posting_blocks(words.where("id < 0"), str(tmp_path / "b"), 0)
    terms = terms_of(spark.createDataFrame(ASKED, "query string, text string"))
    assert keyword_topk_of(spark.read.schema(stored.schema).parquet(str(tmp_path / "b")), terms, 3).count() == 0
    assert keyword_topk_of(stored, terms.where("query = 'no such'"), 3).count() == 0


def test_blocks_of_texts_are_those_of_postings(spark, tmp_path):
    rows = texts_of(3, 200) + [(7, "alpha thing alpha"), (7, "the of"), (None, "alpha"), (900, None), (901, ""), (902, "of the")]
    df = spark.createDataFrame(rows, "id long, content string").repartition(3)
    made = []
    for name, words in (("rows", postings(df)), ("texts", text_words(df))):
        write_posting_blocks(words, str(tmp_path / name), len(rows))
        stored = spark.read.parquet(str(tmp_path / name))
        held = stored.select("term", "block", "most", "n_texts", "n_postings", F.explode("texts").alias("text"))
        made.append(sorted(map(str, held.select("*", "text.id", "text.positions").drop("text").collect())))
    assert made[0] == made[1] and made[0]
    # Words are not spread to rows and gathered again.
    plan = keyword_blocks._listed(text_words(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def shuffled(spark):
    """The shuffle files that lie in the session's own folders, with their sizes."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name: f.stat().st_size for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*.data")}


def test_shuffle_files_go_when_a_table_is_stored(spark, tmp_path):
    df = spark.createDataFrame(texts_of(1, 50), "id long, content string").repartition(3)
    before, setting = shuffled(spark), spark.conf.get(CLEANUP)
    write_posting_blocks(text_words(df), str(tmp_path / "b"), 50)
    until = time.time() + 20
    while (left := set(shuffled(spark)) - set(before)) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP) == setting


def test_words_are_shuffled_once_and_packed(spark, tmp_path, monkeypatch):
    draw = random.Random(7)
    words = [f"{draw.randrange(10**6):06x}q" for _ in range(5000)]
    rows = [(k, " ".join(words[int(draw.random() ** 3 * 5000)] for _ in range(400))) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, content string").repartition(3).localCheckpoint()
    for name, texts in (("rows", postings(df)), ("texts", text_words(df))):
        before = shuffled(spark)
        monkeypatch.setattr(keyword_blocks, "released", lambda spark: nullcontext())
        write_posting_blocks(texts, str(tmp_path / name), len(rows))
        # Rows of Spark's, moved three times, took several times as much as the texts have characters.
        new = sum(size for file, size in shuffled(spark).items() if file not in before)
        assert 0 < new < sum(len(text) for _, text in rows) / 2


def test_shares_and_blocks_hold_every_word_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_blocks, "BLOCK_TEXTS", 4)
    monkeypatch.setattr(keyword_blocks, "SHARE_TEXTS", 16)
    rows = texts_of(5, 100)
    words = postings(spark.createDataFrame(rows, "id long, content string").withColumn("id", F.concat(F.lit("t"), "id")).repartition(3))
    # Of a text that comes in pieces, positions come in any order.
    words = words.orderBy(F.xxhash64("id", "pos"))
    write_posting_blocks(words, str(tmp_path / "b"), len(rows))
    stored = spark.read.parquet(str(tmp_path / "b"))
    held = stored.select("term", "block", "most", "n_texts", "n_postings", F.posexplode("texts").alias("n", "text")).collect()
    places = [(r["text"]["id"], r["term"], pos) for r in held for pos in r["text"]["positions"]]
    assert sorted(places) == sorted(map(tuple, words.select("id", "term", "pos").collect()))
    assert len({(r["term"], r["block"], r["n"]) for r in held}) == len(held) and len({r["block"] >> 20 for r in held}) == 7
    of_block, of_row = {}, {}
    for r in held:
        assert r["text"]["positions"] == sorted(r["text"]["positions"])
        of_block.setdefault(r["block"], set()).add(r["text"]["id"])
        of_row.setdefault((r["term"], r["block"], r["most"], r["n_texts"], r["n_postings"]), []).append(len(r["text"]["positions"]))
    assert max(map(len, of_block.values())) == 4 and sum(map(len, of_block.values())) == len({i for i, _, _ in places})
    assert all((max(n), len(n), sum(n)) == (most, texts, all_) for (_, _, most, texts, all_), n in of_row.items())


def test_places_that_do_not_fit_one_number_are_put_in_the_same_order(monkeypatch):
    draw = np.random.default_rng(3)
    text, pos, term = draw.integers(0, 50, 4000), draw.permutation(4000), draw.integers(0, 3, 4000)
    fits = keyword_blocks._cover_scores(text, pos, term, 3, 50)
    monkeypatch.setattr(keyword_blocks, "LARGEST", 1)
    assert np.array_equal(fits, keyword_blocks._cover_scores(text, pos, term, 3, 50)) and fits.all()
    batch = pa.RecordBatch.from_arrays(
        [pa.array([5] * 4000, pa.int32()), pa.array(text), pa.array(term.astype(str)), pa.array(pos, pa.int32())], ["share", "id", "term", "pos"]
    )
    packed = next(keyword_blocks._by_share(iter([batch])))
    small = keyword_blocks._by_block(7)(pa.Table.from_batches([packed]))
    monkeypatch.undo()
    assert small.equals(keyword_blocks._by_block(7)(pa.Table.from_batches([packed]))) and small.num_rows > 20


@pytest.mark.parametrize("positions", [1, 2**20])
def test_of_a_block_the_best_and_what_draws_level_are_kept(blocks, monkeypatch, positions):
    _, _, stored = blocks
    long_ones = stored.where("block >= 60").groupBy("term").agg(F.flatten(F.collect_list("texts")).alias("texts")).collect()
    rows = pa.Table.from_pylist([{"term": r["term"], "texts": [t.asDict() for t in r["texts"]]} for r in long_ones])
    monkeypatch.setattr(keyword_blocks, "HELD_POSITIONS", positions)
    block = keyword_blocks._Block(rows)
    place = {t: n for n, t in enumerate(rows["term"].to_pylist())}
    asked = np.array([[place["alpha"], place["beta"]], [place["gamma"], place["delta"]]])
    number, text, scores = block.best(asked, np.zeros(2), None)
    for n in (0, 1):
        every = sorted(scores[number == n], reverse=True)
        assert len(every) > 50 and len(set(text[number == n])) == len(every)
        some, _, best = block.best(asked, np.zeros(2), 3)
        assert sorted(best[some == n], reverse=True) == [s for s in every if s >= every[2] - 1e-6]
        some, _, best = block.best(asked, np.array([every[9]] * 2), None)
        assert sorted(best[some == n], reverse=True) == [s for s in every if s >= every[9] - 1e-6]


def test_codes_in_use_and_in_order():
    draw = np.random.default_rng(2)
    for n in (3, 50, 10_000):
        codes = draw.integers(0, n, 400).astype("i4")
        used, place = keyword.used_of(codes, n)
        assert used.tolist() == sorted(set(codes.tolist())) and np.array_equal(used[place], codes)
        assert np.array_equal(keyword.in_order(codes), np.argsort(codes, kind="stable"))


def test_an_index_is_little_more_than_its_words(spark, tmp_path, monkeypatch):
    """Postings are shuffled packed, missing ids and repeated texts included, and an older index is still found by its folders."""
    draw = random.Random(9)
    words = [f"{draw.randrange(10**6):06x}q" for _ in range(4000)]
    rows = [(k, " ".join(words[int(draw.random() ** 3 * 4000)] for _ in range(300))) for k in range(1500)]
    df = spark.createDataFrame([*rows, (None, "hot ice"), (3, "hot")], "id long, content string").repartition(3).localCheckpoint()
    monkeypatch.setattr(keyword, "released", lambda spark, settings: nullcontext())
    monkeypatch.setattr(keyword, "BUCKET_TEXTS", 300)
    before, path = shuffled(spark), str(tmp_path / "p")
    keyword.write_postings(text_words(df), path, len(rows))
    new = sum(size for file, size in shuffled(spark).items() if file not in before)
    # As rows of terms they took as much as the texts have characters.
    assert 0 < new < sum(len(text) for _, text in rows) / 2
    want = postings(df)
    assert sorted(map(str, keyword.read_postings(spark, path).collect())) == sorted(map(str, want.collect()))
    some = ["hot", words[0], words[7], "no such"]
    by_term = sorted(map(str, want.where(F.col("term").isin(some)).collect()))
    assert sorted(map(str, keyword.read_postings(spark, path, some).collect())) == by_term
    old = spark.read.parquet(path).drop("n_parts", "bucket").withColumn("n_buckets", F.lit(5)).withColumn("bucket", keyword._bucket(F.col("term"), 5))
    old.write.partitionBy("n_buckets", "bucket").parquet(str(tmp_path / "old"))
    assert sorted(map(str, keyword.read_postings(spark, str(tmp_path / "old"), some).collect())) == by_term


def test_sizes_of_settings():
    assert [size_of(s) for s in ("200k", "8m", "67108864b", "64MB", "1g", "77")] == [204800, 8 << 20, 64 << 20, 64 << 20, 1 << 30, 77]
