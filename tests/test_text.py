import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.functions.text import chunk_text, document_title, english_stem, index_words, split_text, word_tokens
from quernstone.operators.chunks import chunk_documents


@pytest.mark.parametrize("n, sizes", [(0, [0]), (1000, [1000]), (1001, [1000, 101]), (1900, [1000, 1000]), (6500, [1000] * 7 + [200])])
def test_sizes_without_a_place_to_break(n, sizes):
    assert [len(c) for c in split_text("x" * n)] == sizes


def test_short_text_is_kept_as_it_is():
    assert split_text("  a \n") == ["  a \n"]


@pytest.mark.parametrize("mark", [". ", "! ", "? ", "\n"])
def test_break_after_the_last_sentence(mark):
    text = "a" * 850 + mark + "b" * 50 + mark + "c" * 500
    first, second = split_text(text)
    assert first == ("a" * 850 + mark + "b" * 50 + mark[0]).strip()
    # The next chunk starts 100 characters before the cut.
    assert second == (text[850 + len(mark) + 51 - 100 :]).strip()


def test_a_break_before_the_last_fifth_is_not_used():
    assert len(split_text("a" * 700 + ". " + "b" * 700)[0]) == 1000
    assert len(split_text("a" * 800 + ". " + "b" * 700)[0]) == 1000
    assert len(split_text("a" * 801 + ". " + "b" * 700)[0]) == 802


def test_late_boundary_far_into_a_text_makes_progress():
    pieces = split_text("a" * 3999 + "\n" + "b" * 2500)
    assert len(pieces) == 8
    assert sum(len(p) for p in pieces) == 6500 + 7 * 100
    assert all(len(p) <= 1000 for p in pieces)


def test_blank_chunks_are_dropped(spark):
    df = spark.createDataFrame([("p", " " * 2500 + "end"), ("q", None), ("r", "")], "source_path string, text string")
    rows = chunk_documents(df).orderBy("source_path", "chunk_index").collect()
    assert [(r["source_path"], r["chunk_index"], r["content"]) for r in rows] == [("p", 0, "end"), ("r", 0, "")]
    assert rows[0]["metadata"].asDict() == {"title": "p", "source_file": "p", "chunk_index": 0, "total_chunks": 1}


def test_chunk_column_equals_the_function(spark):
    texts = ["", "é. " * 900, "x" * 2345, "line\n" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = df.select("i", chunk_text("text").alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [split_text(t) for t in texts]
    with pytest.raises(ValueError):
        chunk_text("text", 100, 90)


@pytest.mark.parametrize(
    "text, path, title",
    [
        ("# Test Document\n\nThis is test content.", "kb/a.md", "Test Document"),
        ("intro\n#   Later  heading\n# Second", "kb/a.md", "Later  heading"),
        ("## Not this\n#nor this", "kb/deep/a.md", "a.md"),
        ("", "a.md", "a.md"),
    ],
)
def test_titles(spark, text, path, title):
    df = spark.createDataFrame([(text, path)], "t string, p string")
    assert df.select(document_title(F.col("t"), F.col("p"))).first()[0] == title


# Words and stems from the published vocabulary of the stemmer.
STEMS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consolation consol consolations consol
consolatory consolatori console consol consoling consol conspiracies conspiraci conspirators conspir
constable constabl constancy constanc knackeries knackeri knavish knavish kneaded knead kneeling kneel
knight knight knightly knight knives knive knocker knocker knots knot generate generat generically generic
general general communism communism hopping hop hoping hope running run flies fli dies die cries cri by by say say
gas gas gaps gap agreed agre feed feed relational relat rationalization ration hopefulness hope university univers
abilities abil happily happili sized size succeeding succeed inning inning news news skies sky only onli yellow yellow
""".split()


def test_stems():
    assert [english_stem(w) for w in STEMS[::2]] == STEMS[1::2]
    assert english_stem("q3s") == "q3s"


def test_words_keep_their_places(spark):
    df = spark.createDataFrame([(1, "The runners, and 3.5 DON'T run_fast"), (2, ""), (3, None)], "i int, t string")
    rows = df.select("i", index_words(word_tokens(F.col("t"))).alias("w")).orderBy("i").collect()
    assert rows[0]["w"] == [None, "runner", None, "3", "5", None, None, "run", "fast"]
    assert (rows[1]["w"], rows[2]["w"]) == ([], None)


def test_python_objects_of_a_batch_are_made_by_slices(spark, monkeypatch):
    sizes, udfs = [], []
    monkeypatch.setattr(text.F, "arrow_udf", lambda f, kind: udfs.append(f) or (lambda *columns: None))
    monkeypatch.setattr(text, "split_text", lambda t, size, overlap: [t])
    text.chunk_text("text")
    plain = text.by_slices
    monkeypatch.setattr(text, "by_slices", lambda column, work: plain(column, lambda rows: sizes.append(len(rows)) or work(rows)))
    rows = [None if k % 7 == 0 else str(k) for k in range(1000)]
    assert udfs[0](pa.array(rows, pa.string())).to_pylist() == [None if t is None else [t] for t in rows]
    assert max(sizes) <= text.SLICE_ROWS and sum(sizes) == 1000
    assert udfs[0](pa.array([], pa.string())).to_pylist() == []


def test_a_model_gets_a_batch_by_slices(spark):
    from quernstone.operators.embed import embed_documents

    def model(texts):
        assert 0 < len(texts) <= 256
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(k, "x" * (k % 5) if k % 3 else None) for k in range(1000)], "id long, content string").coalesce(1)
    made = embed_documents(rows, model).collect()
    assert len(made) == 1000
    for r in made:
        n = len(r["content"] or "")
        assert abs(r["embedding"][0] - n / (n * n + 1) ** 0.5) < 1e-6
