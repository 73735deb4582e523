import pytest
from pyspark.sql import functions as F

from quernstone.plans.index import IndexNotReady, build_index, hybrid_search, search
from quernstone.sources.build_log import index_status
from quernstone.sources.files import list_files, read_text_documents
from quernstone.sources.scratch import scratch_path

TEXTS = {
    "guide.md": "# User guide\n\nConnect the warehouse before running queries. Queries are read only.",
    "deep/api.md": "# API\n\n" + "The search function returns ranked chunks. " * 60,
    "faq.md": "How do I reset a password? Ask the administrator. Hybrid search combines both lists.",
    "deep/50% a+b é.md": "no heading here, nor any word of the others",
    "notes.txt": "not markdown",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    for name, text in TEXTS.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    return str(root)


@pytest.fixture(scope="module")
def root(spark, folder):
    path = scratch_path(spark, "index")
    assert index_status(spark, path).first()["status"] == "pending"
    with pytest.raises(IndexNotReady, match="pending"):
        search(spark, path, "anything")
    build_index(read_text_documents(spark, folder), path)
    return path


def test_list_files(spark, folder):
    rows = list_files(spark, folder, ".md").collect()
    assert sorted(r["key"].split("/")[-1] for r in rows) == ["50% a+b é.md", "api.md", "faq.md", "guide.md"]
    assert {r["key"].split("/")[-1]: r["size"] for r in rows}["guide.md"] == len(TEXTS["guide.md"])
    assert list_files(spark, folder).count() == 5


def test_read_text_documents(spark, folder):
    rows = {r["source_path"].split("/")[-1]: r["text"] for r in read_text_documents(spark, folder).collect()}
    assert rows == {name.split("/")[-1]: text for name, text in TEXTS.items() if name.endswith(".md")}


def test_built_tables(spark, root):
    status = index_status(spark, root).first()
    assert (status["status"], status["last_error"]) == ("ready", None)
    assert status["last_build_started_at"] <= status["last_build_completed_at"]
    chunks = spark.read.parquet(f"{root}/builds/{status['version']}/chunks")
    assert chunks.count() == status["document_count"] == chunks.select("id").distinct().count()
    api = chunks.where(F.col("source_path").endswith("api.md")).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in api] == list(range(len(api))) and len(api) > 2
    assert {r["metadata"]["title"] for r in api} == {"API"}
    assert {r["metadata"]["total_chunks"] for r in api} == {len(api)}
    assert spark.read.parquet(f"{root}/builds/{status['version']}/vectors").count() == chunks.count()


def test_search_modes(spark, root):
    words = search(spark, root, "resetting passwords", 3, "keyword").collect()
    assert [r["metadata"]["title"] for r in words] == ["faq.md"]
    assert words[0]["search_type"] == "keyword"
    meaning = search(spark, root, "warehouse query", 2, "semantic").collect()
    assert meaning[0]["metadata"]["title"] == "User guide" and len(meaning) == 2
    both = search(spark, root, "hybrid search", 3).collect()
    assert both[0]["metadata"]["title"] == "faq.md"
    assert (both[0]["semantic_rank"], both[0]["keyword_rank"], both[0]["rank"]) == (1, 1, 1)
    assert [r["rank"] for r in both] == [1, 2, 3]
    assert search(spark, root, "the of and", 3, "keyword").count() == 0
    assert search(spark, root, "hybrid search", 3, "no such mode").first()["id"] == both[0]["id"]


def test_a_model_of_the_caller(spark, folder):
    path = scratch_path(spark, "index")
    # Texts with neither word lean to the second, so that none ties with the text that holds both.
    model = lambda texts: [[t.lower().count("password") + 0.01, t.lower().count("search") + 0.02] for t in texts]
    build_index(read_text_documents(spark, folder), path, model)
    assert search(spark, path, "password", 1, "semantic", model).first()["metadata"]["title"] == "faq.md"


def test_failed_and_empty_builds(spark, folder):
    path = scratch_path(spark, "index")
    documents = read_text_documents(spark, folder)

    def broken(texts):
        raise RuntimeError("model is down")

    with pytest.raises(Exception, match="model is down"):
        build_index(documents, path, broken)
    failed = index_status(spark, path).first()
    assert failed["status"] == "failed" and "model is down" in failed["last_error"]
    with pytest.raises(IndexNotReady, match="failed"):
        search(spark, path, "anything")

    build_index(documents, path, cluster_vectors=True)
    first = index_status(spark, path).first()
    assert (first["status"], first["last_error"]) == ("ready", None)
    near = search(spark, path, "warehouse query", 2, "semantic", probes=100)
    assert near.collect() == search(spark, path, "warehouse query", 2, "semantic").collect()

    build_index(documents.where(F.lit(False)), path)
    empty = index_status(spark, path).first()
    assert (empty["status"], empty["document_count"], empty["version"]) == ("ready", first["document_count"], first["version"])
    assert search(spark, path, "password", 1, "keyword").count() == 1


def test_an_index_that_never_had_documents(spark, folder):
    path = scratch_path(spark, "index")
    build_index(read_text_documents(spark, folder).where(F.lit(False)), path)
    assert search(spark, path, "anything").count() == 0


def test_hybrid_gives_as_many_as_asked_for(spark):
    vectors = spark.range(400).select("id", F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"))
    words = spark.range(400).select("id", F.lit("word").alias("term"), F.lit(1).alias("pos"))
    found = hybrid_search(vectors, words, [1.0, 0.5], ["word"], k=200)
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, 201))
