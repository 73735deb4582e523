"""Refreshed indexes against indexes built anew, and searches of them for a table of queries."""

import pytest
from pyspark.sql import functions as F

from quernstone.plans import refresh
from quernstone.plans.batch import search_table
from quernstone.plans.index import IndexNotReady, build_index, search
from quernstone.plans.layers import layers_of, live_postings, live_table, posting_blocks
from quernstone.plans.refresh import compact_index, document_changes, refresh_index
from quernstone.sources.build_log import index_status
from quernstone.sources.scratch import scratch_path

SCHEMA = "source_path string, text string"
LONG = "The rivers rise in spring. The boats stay ashore until the water falls again. "
BEFORE = [
    ("a.md", "# First\n\nAlpha beta gamma."), ("b.md", LONG * 40), ("c.md", "Only passwords here."), ("d.md", "goes away"),
    ("e.md", "twice"), ("e.md", "twice"), (None, "without a path"), ("n.md", None), ("blank.md", " " * 1500),
]
AFTER = [
    ("a.md", "# First\n\nAlpha beta gamma."), ("b.md", LONG * 40 + "And then some more."), ("c.md", "Only passwords here."),
    ("e.md", "twice"), (None, "without a path"), (None, "another without"), ("new.md", "Alpha alpha passwords. " * 90),
    ("n.md", None), ("m.md", "Only passwords here."),
]


def letter_model(log=None):
    """A model that travels with its tasks; with a file, it notes each text it is given."""

    def model(texts):
        if log:
            with open(log, "a", encoding="utf-8") as file:
                file.writelines(f"{hash(t)}\n" for t in texts)
        return [[t.lower().count(c) + 1.0 for c in "aeiost"] for t in texts]

    return model


plain_model = letter_model()


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def tables(spark, root):
    """What an index holds, but for its ids."""
    layers = layers_of(spark, root, index_status(spark, root).first()["version"])
    chunks = live_table(spark, layers, "chunks").select("id", "source_path", "chunk_index", "content", "metadata.title", "metadata.total_chunks")
    name = chunks.select("id", "source_path", "chunk_index", "content")
    rows = sorted((tuple(r)[1:] for r in chunks.collect()), key=repr)
    vectors = live_table(spark, layers, "vectors").join(name, "id")
    made = sorted(((r["source_path"], r["chunk_index"], r["content"], tuple(r["embedding"])) for r in vectors.collect()), key=repr)
    words = live_postings(spark, layers).join(name, "id").select("source_path", "chunk_index", "term", "pos")
    return rows, made, sorted((tuple(r) for r in words.collect()), key=repr)


@pytest.fixture(scope="module")
def anew(spark):
    root = scratch_path(spark, "index")
    build_index(docs(spark, AFTER), root, plain_model)
    return root


def test_a_refreshed_index_is_that_built_anew(spark, anew, tmp_path):
    root, log = scratch_path(spark, "index"), tmp_path / "texts"
    model = letter_model(str(log))
    build_index(docs(spark, BEFORE), root, model, query_tables=True)
    log.write_text("")
    first = index_status(spark, root).first()
    status = refresh_index(docs(spark, AFTER), root, model).first()
    assert status["status"] == "ready" and status["version"] != first["version"]
    assert tables(spark, root) == tables(spark, anew)
    whole = index_status(spark, anew).first()
    assert status["document_count"] == whole["document_count"]
    # Only chunks of new and changed texts were embedded, each once.
    layers = layers_of(spark, root, status["version"])
    new = spark.read.parquet(f"{layers[1].folder}/chunks")
    assert {r[0] for r in new.select("source_path").distinct().collect()} == {"b.md", "e.md", None, "new.md", "m.md"}
    assert new.where("source_path is null").count() == 1
    assert len(log.read_text().split()) == new.count() < whole["document_count"]
    # Ids go on above the others.
    ids = [r["id"] for r in live_table(spark, layers, "chunks").select("id").collect()]
    assert len(set(ids)) == len(ids)
    asked = spark.createDataFrame([("p", "passwords"), ("a", "alpha"), ("r", "the water falls"), ("s", "the")], "query string, text string")
    for mode in ("keyword", "semantic", "hybrid"):
        for query, text in (("p", "passwords"), ("a", "alpha")):
            key = lambda rows: [(r["score"], r["metadata"]["source_file"] or "", r["content"]) for r in rows]
            one = search(spark, root, text, 50, mode, plain_model).collect()
            assert sorted(key(one)) == sorted(key(search(spark, anew, text, 50, mode, plain_model).collect()))
            many = search_table(spark, root, asked, 50, mode, plain_model).where(F.col("query") == query)
            assert [(r["rank"], r["id"], r["score"]) for r in many.orderBy("rank").collect()] == [
                (r["rank"], r["id"], r["score"]) for r in one
            ]
    again = refresh_index(docs(spark, AFTER), root, model).first()
    assert again["version"] == status["version"]
    compact = compact_index(spark, root).first()
    assert len(layers_of(spark, root, compact["version"])) == 1
    assert tables(spark, root) == tables(spark, anew)
    assert len(log.read_text().split()) == new.count()
    assert posting_blocks(spark, layers_of(spark, root, compact["version"])).count() > 0


def test_changes(spark, anew):
    chunks = live_table(spark, layers_of(spark, anew, index_status(spark, anew).first()["version"]), "chunks")
    rows = [r for r in AFTER if r[0] != "c.md"] + [("c.md", "changed"), ("m.md", "Only passwords here.")]
    found = {(r["source_path"], r["change"], r["copies"]) for r in document_changes(docs(spark, rows), chunks).collect()}
    assert found == {("c.md", "gone", 1), ("c.md", "new", 1), ("m.md", "gone", 1), ("m.md", "new", 2)}


def test_many_layers_are_merged(spark, monkeypatch):
    monkeypatch.setattr(refresh, "MOST_LAYERS", 3)
    root = scratch_path(spark, "index")
    rows = [(f"{k}.md", f"text number {k}") for k in range(6)]
    counts = []
    for n in (2, 3, 4, 6, 5):
        version = refresh_index(docs(spark, rows[:n]), root).first()["version"]
        counts.append(len(layers_of(spark, root, version)))
        found, _, _ = tables(spark, root)
        assert sorted(r[0] for r in found) == [f"{k}.md" for k in range(n)]
    assert counts == [1, 2, 1, 2, 1]
    # New chunks are weighted as in the base, and found.
    assert search(spark, root, "number 4", 3, "keyword").first()["metadata"]["source_file"] == "4.md"
    assert search(spark, root, "text number", 9, "semantic").count() == 5


def test_a_failing_refresh_leaves_the_index(spark):
    root = scratch_path(spark, "index")
    before = build_index(docs(spark, BEFORE), root, plain_model).first()

    def broken(texts):
        raise RuntimeError("no model today")

    with pytest.raises(Exception, match="no model today"):
        refresh_index(docs(spark, AFTER), root, broken)
    status = index_status(spark, root).first()
    assert status["status"] == "failed" and status["version"] == before["version"]
    assert refresh_index(docs(spark, AFTER), root, plain_model).first()["status"] == "ready"


def test_everything_goes(spark):
    root = scratch_path(spark, "index")
    build_index(docs(spark, BEFORE), root, plain_model, cluster_vectors=True)
    status = refresh_index(docs(spark, AFTER[:1]), root, plain_model).first()
    assert status["document_count"] == 1
    near = search(spark, root, "alpha", 5, "semantic", plain_model, probes=100)
    assert [r["metadata"]["source_file"] for r in near.collect()] == ["a.md"]
    assert refresh_index(docs(spark, []), root, plain_model).first()["document_count"] == 0
    assert search(spark, root, "alpha", 5, "hybrid", plain_model).count() == 0


def test_a_table_of_queries_needs_its_tables(spark, anew):
    asked = spark.createDataFrame([("q", "alpha")], "query string, text string")
    with pytest.raises(ValueError, match="query_tables"):
        search_table(spark, anew, asked, 5, "keyword", plain_model)
    with pytest.raises(IndexNotReady):
        search_table(spark, scratch_path(spark, "index"), asked)
