"""Spelling variants: words a single edit apart, found in a trie of letter-group counts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text, stored

#: Runs of ASCII letters and of the letters (and two signs) from U+00C0 to U+00FF are words.
LETTERS = "a-zA-ZÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A word's form occurs at least so many times as often.
FORM_TIMES = 5
#: Letter groups: code points by their remainder. Of each word, the counts of the first few say where in the trie it lies.
GROUPS, TOP_GROUPS = 11, 6
#: Words of a part of the trie that is searched at once, and searching words at a time.
PART_WORDS, SEARCH_WORDS = 20_000, 2_000
_HELD_WORDS = 300_000
#: Levels number their nodes by parent and count in one key. Longer words may share a node; verification tells them apart.
_SPAN = np.int64(2**20)
#: Doubled steps along forms: each form is FORM_TIMES as frequent, so no chain of 64-bit counts has 2**5 steps.
_DOUBLINGS = 5


def word_counts(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_letters: int = LEAST_LETTERS,
    drop_one_in: int | None = None,
) -> DataFrame:
    """How often each word of ``least_letters`` letters or more occurs: ``word, n``.

    Words are the maximal runs of ``LETTERS`` with A-Z lower-cased. With
    ``drop_one_in``, the words of a document whose CRC-32 of ``<id>:<word>`` it
    divides lose the letter at the place of the checksum modulo their length,
    which plants variants; rows without id are left as they are. Tasks count
    before the shuffle. Null and empty texts have no words; every row given
    counts, repeated ones too; no rows give no words.
    """
    pattern = re.compile(f"[{LETTERS}]{{{least_letters},}}")
    keys = F.col(id_column).cast("string")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # The lower case of bytes touches A-Z alone.
                words = Counter(pattern.findall(text.as_py().encode().lower().decode()))
                if drop_one_in and key is not None:
                    words = without_letters(f"{key}:", words)
                held.update(words)
                if len(held) > _HELD_WORDS:
                    yield counted(held)
                    held.clear()
        yield counted(held)

    def without_letters(key: str, words: Counter[str]) -> Counter[str]:
        start = zlib.crc32(key.encode())
        out: Counter[str] = Counter()
        for word, n in words.items():
            h = zlib.crc32(word.encode(), start)
            if h % drop_one_in == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= least_letters:
                out[word] += n
        return out

    def counted(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
        )

    rows = documents.select(keys.alias("id"), plain_text(text_column).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def group_counts(words: list[str], groups: int = GROUPS) -> np.ndarray:
    """Of each word, how many of its letters fall into each group."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64) % groups
    owner = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(owner * groups + letters, minlength=len(words) * groups).reshape(-1, groups)


def one_edit_apart(a: str, b: str) -> bool:
    """Whether one code point inserted, deleted or replaced makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class CountTrie:
    """Words by the counts of their letter groups, one group a level; words of equal counts share a leaf.

    An edit of one letter takes at most one from a group and adds at most one
    to another. A search goes down with a budget of one surplus and one
    deficit, and what it reaches is verified. To meet each pair once, the
    deficit may only follow the surplus: an insertion leads from the shorter
    word to the longer, a replacement to the greater counts, and of words with
    equal counts to the greater word. Many words search together, a level at a
    time, so that each level is a few array steps.
    """

    def __init__(self, words: list[str], counts: np.ndarray):
        order = np.lexsort(counts.T[::-1])
        self.words = [words[k] for k in order.tolist()]
        self.order = order
        counts = counts[order]
        self.levels: list[np.ndarray] = []
        node = np.zeros(len(order), np.int64)
        for level in range(counts.shape[1]):
            keys, node = np.unique(node * _SPAN + counts[:, level], return_inverse=True)
            self.levels.append(keys)
        # Words of a leaf stand together.
        self.leaf_starts = np.searchsorted(node, np.arange(node[-1] + 2 if len(node) else 1))

    def _child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.levels[level]
        at = np.minimum(np.searchsorted(keys, node * _SPAN + count), len(keys) - 1)
        return at, keys[at] == node * _SPAN + count

    def reach(
        self, counts: np.ndarray, tops: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a searching word (by row of ``counts``) and a leaf within its budget, and what was spent.

        With ``tops``, the first counts of the part of the trie that each word
        searches, the search starts there, with what leads there spent.
        """
        query, node = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        spent = np.zeros(len(counts), np.int64)
        first = 0 if tops is None else tops.shape[1]
        for level in range(first):
            at, on = self._child(level, node, tops[query, level])
            query, node = query[on], at[on]
        if tops is not None:
            spent = np.abs(tops - counts[:, :first]).sum(axis=1)[query]
        for level in range(first, len(self.levels)):
            parts = []
            # Nothing, a surplus if none is spent, a deficit if the surplus alone is spent.
            for change, before in ((0, None), (1, 0), (-1, 1)):
                may = slice(None) if before is None else spent == before
                asked, from_node, so_far = query[may], node[may], spent[may]
                at, on = self._child(level, from_node, counts[asked, level] + change)
                parts.append((asked[on], at[on], so_far[on] + abs(change)))
            query, node, spent = (np.concatenate(x) for x in zip(*parts))
        return query, node, spent

    def near(self, words: list[str], counts: np.ndarray, tops: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Verified pairs: place of a searching word, and place of a word as it was given."""
        for start in range(0, len(words), SEARCH_WORDS):
            rows = slice(start, start + SEARCH_WORDS)
            query, leaf, spent = self.reach(counts[rows], None if tops is None else tops[rows])
            for q, at, used in zip(query.tolist(), leaf.tolist(), spent.tolist()):
                word = words[start + q]
                for k in range(self.leaf_starts[at], self.leaf_starts[at + 1]):
                    other = self.words[k]
                    if (used or word < other) and one_edit_apart(word, other):
                        yield start + q, int(self.order[k])


def _reachable(top: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The first counts of all words that a search from a word with these can lead to."""
    changed = lambda t, k, by: t[:k] + (t[k] + by,) + t[k + 1 :]
    more = [(k, changed(top, k, 1)) for k in range(len(top))]
    return [top, *(t for _, t in more)] + [
        changed(t, later, -1) for k, t in more for later in range(k + 1, len(top)) if t[later]
    ]


def near_words(words: DataFrame) -> DataFrame:
    """Of each word with another one edit apart: ``word, n_near, form_n, near_form``, from distinct ``word, n``.

    ``near_form`` is the most frequent word one edit apart (of equally frequent
    ones the first by code points) and ``form_n`` how often it occurs. Words
    without a near word are left out.

    The upper levels of the trie are the places that words are sent to: a word
    is kept at the counts of its first groups and searches all places that its
    budget leads to. Places are dealt to parts by hash; one with more words
    than a part holds is dealt out over several, all of which are searched. A
    task holds the words of one part at a time and lets the searching words
    pass by, so that its memory has a bound. It answers with one row per word
    met, which are combined by word; pairs are not passed on.
    """
    spark = words.sparkSession

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tops = group_counts(batch.column(0).to_pylist())[:, :TOP_GROUPS].tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([",".join(map(str, t)) for t in tops])], ["word", "n", "top"]
            )

    def spread(tops: pa.Array) -> pa.Array:
        known = tops.dictionary_encode()
        near = [_reachable(tuple(map(int, top.split(",")))) for top in known.dictionary.to_pylist()]
        named = [[",".join(map(str, t)) for t in reached] for reached in near]
        return pa.array(named, pa.list_(pa.string())).take(known.indices)

    placed = stored(words.select("word", "n").mapInArrow(place, "word string, n long, top string"), "words")
    sizes = stored(placed.groupBy("top").agg(F.count(F.lit(1)).alias("held")), "places")
    total = sizes.agg(F.sum("held")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_WORDS))
    shares = sizes.select("top", F.ceil(F.col("held") / PART_WORDS).cast("int").alias("shares"))
    part_of = lambda share: F.pmod(F.xxhash64(F.col("top"), share), F.lit(parts)).cast("int")
    kept = placed.join(shares, "top").withColumn("share", F.pmod(F.xxhash64("word"), F.col("shares")).cast("int"))
    reach = F.arrow_udf(spread, "array<string>")
    asking = placed.select("word", "n", F.explode_outer(reach("top")).alias("top")).join(shares, "top")
    # Shares of one place that lie in one part are searched at once.
    shares_in = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("shares") - 1), part_of))
    rows = kept.select(part_of(F.col("share")).alias("part"), F.lit(False).alias("asks"), "word", "n", "top").unionByName(
        asking.select(F.explode(shares_in).alias("part"), F.lit(True).alias("asks"), "word", "n", "top")
    )
    dealt = rows.repartition(parts, "part").sortWithinPartitions("part", "asks")
    found = dealt.mapInArrow(_search, "word string, n_near long, form_n long, near_form string")
    # The order of strings is that of their code points.
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), "near_form"))
    combined = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return combined.select("word", "n_near", (-F.col("best.rank")).alias("form_n"), "best.near_form")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parts in order, each part's own words before those that search it, to what is near each word met."""
    part, trie, held, held_n = None, None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.r_[True, (np.diff(parts) != 0) | (asks[1:] != asks[:-1])]).tolist()
        for start, end in zip(edges, [*edges[1:], batch.num_rows]):
            rows = batch.slice(start, end - start)
            words, n = rows.column(2).to_pylist(), rows.column(3).to_pylist()
            if parts[start] != part:
                part, trie, held, held_n = parts[start], None, [], []
            if not asks[start]:
                held += words
                held_n += n
                continue
            if not held:
                continue
            if trie is None:
                trie = CountTrie(held, group_counts(held))
            known = rows.column(4).dictionary_encode()
            tops = np.array([top.split(",") for top in known.dictionary.to_pylist()], np.int64)
            met: dict[str, tuple[int, int, str]] = {}
            for q, k in trie.near(words, group_counts(words), tops[known.indices.to_numpy()]):
                for word, other, other_n in ((words[q], held[k], held_n[k]), (held[k], words[q], n[q])):
                    n_near, best_n, best = met.get(word, (0, 0, ""))
                    better = other_n > best_n or (other_n == best_n and other < best)
                    met[word] = (n_near + 1, *((other_n, other) if better else (best_n, best)))
            if met:
                n_near, best_n, best = zip(*met.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met.keys(), pa.string()), pa.array(n_near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best)],
                    ["word", "n_near", "form_n", "near_form"],
                )


def spelling_variants(
    words: DataFrame, least_count: int = LEAST_COUNT, form_times: int = FORM_TIMES
) -> DataFrame:
    """Variants of each word that occurs ``least_count`` times or more: ``word, n, n_near, form, form_n, root``.

    ``words`` has ``word, n``, a row per distinct word (as ``word_counts``
    gives them). Two words are near if one edit of a code point leads from one
    to the other. A word's form is its most frequent near word (of equal ones
    the first by code points), if that occurs ``form_times`` times as often at
    least, and its root is where forms lead to in the end. Words without form
    are their own root. Null words are left out; no rows give no rows; other
    columns are not read.
    """
    if form_times < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = stored(words.where(F.col("word").isNotNull() & (F.col("n") >= least_count)).select("word", "n"), "frequent")
    near = near_words(words)
    is_form = F.col("form_n") >= form_times * F.col("n")
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near_form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    table = stored(table, "forms")
    # Only words with a form lead anywhere; each step doubles how far.
    steps = table.where("form is not null").select("word", F.col("form").alias("to"))
    for _ in range(_DOUBLINGS):
        onward = steps.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        steps = stored(
            steps.join(onward, "to", "left").select("word", F.coalesce("beyond", "to").alias("to")), "steps"
        )
    roots = steps.withColumnRenamed("to", "root")
    return table.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
