"""Quality rules: counts by plain loops, boilerplate by host, and who is kept."""

import re
from collections import Counter, defaultdict

from conftest import words_of

from quernstone.llm.quality import kept_documents, quality_rules

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if words_of(line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def judged(rows, min_texts, min_percent):
    """``(removed words, kept)`` by plain sets; rows are (id, text, host)."""
    texts = defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
    flat = lambda line: " ".join(words_of(line)).lower()
    found = defaultdict(Counter)
    for host, those in texts.items():
        for text in those:
            found[host].update({flat(line) for line in text.split("\n")} - {""})
    out = []
    for i, text, host in rows:
        least = max(min_texts, len(texts[host]) * min_percent / 100)
        lines = [flat(line) for line in (text or "").split("\n")]
        removed = sum(len(line.split(" ")) for line in lines if line and found[host][line] >= least)
        n, _, _, _, repeated = counts(text)
        failed = n < 50 or 100 * repeated > 50 * n
        out.append((i, removed, failed, not failed and 100 * removed <= 50 * n))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["id"], r["n_removed"], r["base_failed"], r["kept"]) for r in df.collect()), key=repr)


def test_documents(documents):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    found = quality_rules(documents)
    plain = {i: counts(text) for i, text, _ in rows}
    assert {r["id"]: tuple(r[c] for c in COUNTS) for r in found.collect()} == plain
    assert got(found) == judged(rows, 20, 5)
    kept = kept_documents(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, _, k in sorted(judged(rows, 20, 5)) if k]


def test_boilerplate_of_a_host(spark):
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(60))
    menu = " ".join(f"menu{j}" for j in range(70))
    rows = [(k, f"{own(k)}\n {menu.upper()} ", "host" if k < 30 else None) for k in range(60)]
    rows += [(100 + k, f"{own(100 + k)}\n{menu}", "other") for k in range(10)]  # too few
    rows += [(200 + k, own(200), "copies") for k in range(40)]  # copies are one text
    rows += [(300, own(300), "host")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["id"]: (r["n_removed"], r["kept"]) for r in quality_rules(df).collect()}
    assert all(found[k] == (70, False) for k in range(60))
    assert all(found[k] == (0, True) for k in [*range(100, 110), *range(200, 240), 300])
    assert got(quality_rules(df)) == judged(rows, 20, 5)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    found = quality_rules(odd, min_texts=2, min_percent=1)
    assert got(found) == judged(rows, 2, 1)
    plain = sorted(((i, *counts(text)) for i, text, _ in rows), key=repr)
    assert sorted(((r["id"], *(r[c] for c in COUNTS)) for r in found.collect()), key=repr) == plain
    assert quality_rules(none).count() == 0 and kept_documents(none).count() == 0
    assert kept_documents(odd).columns == odd.columns


def test_boilerplate_lines_go(spark):
    """Found lines go from the kept texts, in all their variants; other hosts and other lines are untouched."""
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(60))
    variants = ("Über UNS  und\tImpressum", " über uns und impressum ", "ÜBER uns und   Impressum")
    rows = [(k, f"{own(k)}\n{variants[k % 3]}\n\n tail  {k} ", "host", -1) for k in range(30)]
    rows += [(100 + k, f"{own(100 + k)}\n{variants[0]}", None, -1) for k in range(10)]  # too few
    rows += [(None, rows[0][1], "host", -1), rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    expected = [
        (i, own(i or 0) + f"\n\n tail  {i or 0} ", h, len(own(i or 0) + f"\n\n tail  {i or 0} ")) if h else (i, text, h, n)
        for i, text, h, n in rows
    ]
    kept = kept_documents(df)
    assert kept.dtypes == df.dtypes
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(expected, key=repr)
