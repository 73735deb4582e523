"""Texts go to the model once, and failed calls leave nothing behind."""

import pytest
from pyspark.sql import functions as F

from quernstone.operators import embedding_store
from quernstone.operators.embed import embed_documents
from quernstone.operators.embedding_store import batches_of, embed_once, store_folders, store_log
from quernstone.plans.index import build_index, search
from quernstone.plans.refresh import refresh_index
from quernstone.sources.scratch import scratch_path

SCHEMA = "id int, content string, embedding string"


def noting_model(log):
    """Counts letters, and notes the sizes of its calls and the texts it got."""

    def model(texts):
        with open(log, "a", encoding="utf-8") as file:
            file.write(f"{len(texts)} " + " ".join(map(repr, texts)).replace("\n", " ") + "\n")
        return [[t.count(c) + 1.0 for c in "abc"] for t in texts]

    return model


def given(log):
    return sum(int(line.split()[0]) for line in log.read_text().splitlines()) if log.exists() else 0


def rows(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA).drop("embedding").repartition(3)


def plain(df):
    return sorted((tuple(r) for r in df.select("id", "content", "embedding").collect()), key=repr)


def test_each_text_goes_to_the_model_once(spark, tmp_path):
    store, log = scratch_path(spark, "store"), tmp_path / "log"
    model = noting_model(str(log))
    first = rows(spark, ["a", "bb", "a", None, "", "c" * 5] + ["hot"] * 300)
    made = embed_once(first, model, store, "letters")
    assert given(log) == 5
    assert plain(made) == plain(embed_documents(first, noting_model(str(tmp_path / "other"))))
    second = rows(spark, ["new", "a", "hot", "new", "other"])
    assert plain(embed_once(second, model, store, "letters")) == plain(embed_documents(second, noting_model(str(tmp_path / "other"))))
    assert given(log) == 7
    # Nothing new: no call, no entry; and results need no model.
    assert embed_once(first, None, store, "letters").count() == 306
    assert [r["n_texts"] for r in store_log(spark, store).orderBy("at").collect()] == [5, 2]
    # Another model has vectors of its own.
    embed_once(second, model, store, "other")
    assert given(log) == 11


def test_a_failed_call_leaves_nothing(spark, tmp_path):
    store, log = scratch_path(spark, "store"), tmp_path / "log"
    texts = rows(spark, [f"text {k}" for k in range(40)] + ["bad"])
    good = noting_model(str(log))

    def breaks(batch):
        if "bad" in batch:
            raise RuntimeError("no vector for this")
        return good(batch)

    with pytest.raises(Exception, match="no vector for this"):
        embed_once(texts, breaks, store, "m")
    assert store_folders(spark, store, "m") == []
    log.unlink(missing_ok=True)
    assert embed_once(texts, good, store, "m").where("embedding is null").count() == 0
    assert given(log) == 41
    with pytest.raises(Exception, match="vectors for"):
        embed_once(rows(spark, ["more", "texts"]), lambda batch: [[1.0]] * (len(batch) + 1), store, "m")


def test_folders_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embedding_store, "MOST_FOLDERS", 3)
    store, log = scratch_path(spark, "store"), tmp_path / "log"
    for k in range(5):
        made = embed_once(rows(spark, [f"{n}" for n in range(k + 1)]), noting_model(str(log)), store, "m")
        assert made.where("embedding is not null").count() == k + 1
        assert len(store_folders(spark, store, "m")) < 3
    assert given(log) == 5


def test_batches_are_bounded_by_texts_and_characters():
    assert list(batches_of([])) == []
    assert list(batches_of(["a"] * 5, 2, 100)) == [(0, 2), (2, 4), (4, 5)]
    assert list(batches_of(["aaa", "b", "c" * 50, "d", "e"], 10, 5)) == [(0, 2), (2, 3), (3, 5)]


def test_no_rows(spark):
    none = spark.createDataFrame([], "id int, content string")
    assert embed_once(none, None, scratch_path(spark, "store"), "m").columns == ["id", "content", "embedding"]


def test_an_index_built_anew_asks_the_model_for_new_texts_only(spark, tmp_path):
    store, log = (scratch_path(spark, "store"), "letters"), tmp_path / "log"
    model = noting_model(str(log))
    docs = lambda *names: spark.createDataFrame([(f"{n}.md", f"text of {n}") for n in names], "source_path string, text string")
    build_index(docs("a", "b"), scratch_path(spark, "index"), model, store=store)
    root = scratch_path(spark, "index")
    build_index(docs("a", "b", "c"), root, model, store=store)
    assert given(log) == 3
    # A document that only moved is cut again but not embedded again.
    moved = docs("a", "b", "d").withColumn("source_path", F.concat(F.lit("new/"), "source_path"))
    refresh_index(moved, root, model, store)
    assert given(log) == 4
    assert search(spark, root, "text", 9, "semantic", model).count() == 3
