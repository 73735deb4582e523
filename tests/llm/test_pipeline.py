"""The corpus pipeline, stage by stage, against plain versions of the stages."""

import itertools

import corpus_pipeline
import pytest
from conftest import LOWER, SF_DIR, words_of
from test_line_dedup import drop
from test_mixing import plain_repeats
from test_packing import check
from test_quality_rules import judged


def five_words(text):
    words = words_of((text or "").translate(LOWER))
    width = min(5, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()


def firsts_of_groups(texts):
    """The smallest id of each group of links by five-word shingles, 80 of 100, by all pairs."""
    sets = {i: five_words(t) for i, t in texts.items()}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        one, two = sets[a], sets[b]
        if one and two and 100 * len(one & two) >= 80 * len(one | two):
            x, y = root(a), root(b)
            least[max(x, y)] = min(x, y)
    return {root(i) for i in sets}


@pytest.fixture(scope="module")
def stages(spark, documents):
    docs, out = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        out.append((name, docs))
    return out


def test_stages_by_plain_versions(documents, stages):
    given = {r["doc_id"]: r for r in documents.collect()}
    quality, lines, copies, mixture, packed = (df for _, df in stages)
    for df in (quality, lines, copies, mixture):
        assert df.schema.names == documents.schema.names and df.dtypes == documents.dtypes
    kept = {i for i, _, _, k in judged([(i, r["text"], r["source"]) for i, r in given.items()], 20, 5) if k}
    assert sorted(r["doc_id"] for r in quality.collect()) == sorted(kept)
    after = {i: text for i, text, _, _ in drop([(i, given[i]["text"]) for i in kept], 10)}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()} == {i: (t, len(t)) for i, t in after.items()}
    firsts = firsts_of_groups(after)
    assert sorted(r["doc_id"] for r in copies.collect()) == sorted(firsts)
    repeats = {i: n for (i, _, _), n in plain_repeats([(i, after[i], given[i]["source"]) for i in firsts]).items()}
    taken = [r["doc_id"] for r in mixture.collect()]
    assert sorted(taken) == sorted(i for i, n in repeats.items() for _ in range(n))
    rows = [r.asDict() for r in packed.collect()]
    assert {r["doc_id"] for r in rows} == set(taken)
    assert sum(r["piece"] == 0 for r in rows) == len(taken)
    once = {i for i in set(taken) if taken.count(i) == 1}
    check([{**r, "id": r["doc_id"], "sequence_id": k} if r["doc_id"] in once else {**r, "id": None} for k, r in
           enumerate({**r, "offset": 0} for r in rows) if r["doc_id"] in once], {i: after[i] for i in once})
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (s, o, n), (t, p, _) in zip(places, places[1:]):
        assert p == (o + n if s == t else 0) and o + n <= 1024


def test_run_gives_the_last_stage(spark, stages):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    one = sorted(tuple(r[c] for c in names) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert one == sorted(tuple(r[c] for c in names) for r in stages[-1][1].collect())


def test_an_empty_table(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_near_copies_between_the_two_rules_are_one(spark, documents):
    words = [f"w{k}" for k in range(200)]
    # Every tenth word of 20 differs: four fifths of the five-word shingles are shared, less than nine tenths of three words.
    other = [f"x{k}" if k in (30, 60, 90, 120) else w for k, w in enumerate(words)]
    far = [f"y{k}" if k % 8 == 0 else w for k, w in enumerate(words)]
    rows = [(k, " ".join(t), "en", "s", 1) for k, t in enumerate((words, other, far))]
    docs = spark.createDataFrame(rows, documents.schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SF_DIR).collect()) == [0, 2]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_pass_each_stage_alike_in_any_partitioning(spark, odd, stage):
    """Rows of odd texts, repeated ones and such without id, with extra columns of clashing names."""
    rows = odd.unionByName(odd.where("doc_id IN (5, 9)").selectExpr("CAST(NULL AS LONG) doc_id", *odd.columns[1:]))
    results = []
    for n in (1, 2, 5, 8):
        made = stage(spark, rows.repartition(n), SF_DIR)
        kept = [c for c in made.columns if c not in ("sequence_id", "offset")]
        results.append(sorted((tuple(r[c] for c in kept) for r in made.collect()), key=repr))
        if stage is not corpus_pipeline.packing:
            assert made.columns == odd.columns and made.dtypes == odd.dtypes
    assert all(r == results[0] for r in results)
    assert results[0] or stage is corpus_pipeline.quality
