"""Keyword search for a table of queries: blocks of postings with a bound on what a text in them can score.

Texts are dealt by their ids to shares of about ``SHARE_TEXTS``, and those of a
share to blocks of ``BLOCK_TEXTS`` texts of about one length, so that blocks
differ in how often terms occur. The postings of a term in a block are one
stored row, with the most often that the term occurs in one of its texts. A
search reads these small columns first. Blocks without one of a query's terms
cannot answer it; of the others, those that could score most are scored first,
and of the rest only those that can still reach the k-th score. Within these,
texts that cannot reach it are left out before their positions are looked at.

Words are shuffled once on writing, and positions once on scoring, both times
compressed (``bytes_of``): a row of Spark's takes many times as much.

Bound: a cover (a shortest span with all m terms) of the text holds an
occurrence of the term that is rarest there, and one occurrence lies in m covers
at most, as the terms that those covers start with all differ. A text with r
occurrences of its rarest term thus scores at most m * r * ``WORD_WEIGHT``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import english_index
from ..functions.vector import SCORE_DIGITS
from ..sources.scratch import kept, released
from .keyword import WORD_WEIGHT, _spread, bytes_of, coded, in_order, tables_of, used_of
from .semantic import rank_hits

#: Texts of a block, and of a share, whose words one task holds at a time.
BLOCK_TEXTS, SHARE_TEXTS = 1024, 4096
#: So many of a query's blocks, those that can score most, are scored before any is ruled out.
FIRST_BLOCKS = 4
#: Blocks of a share are numbered from its own number times this.
SHARE_BLOCKS = 2**20
#: So many words of a task are packed at a time.
HELD_WORDS = 2**20
#: So many sets of terms, and then about so many positions, are looked at in a block at a time.
SETS, HELD_POSITIONS = 128, 2**18
#: Numbers up to this leave room for a position beside them in 64 bits.
LARGEST = 2**32
#: So many asked terms at most go to every task (about 20 MB).
SENT_TERMS = 500_000


def write_posting_blocks(words: DataFrame, path: str, n_texts: int, share_texts: int | None = None) -> None:
    """Store postings by term and block: term, block, most, n_texts, n_postings, texts.

    ``words`` are postings (id, term, pos) or texts (id, words). The words of a
    task are packed by share before their shuffle, and taken apart by block and
    term where a share meets, which writes its rows, by term and block, as they
    are. A frequent term thus spreads over all files. ``n_texts`` need only be
    about the number of texts. Of short texts, a share may hold more
    (``share_texts``), and a block as many times more, so that rows are fewer.
    """
    share_texts = share_texts or SHARE_TEXTS
    id_type = words.schema["id"].dataType.simpleString()
    rows = _listed(words, max(1, math.ceil(n_texts / share_texts))).groupBy("share").applyInArrow(
        _by_block(max(1, BLOCK_TEXTS * share_texts // SHARE_TEXTS)),
        "term string, block long, most int, n_texts int, n_postings int, "
        f"texts array<struct<id:{id_type},positions:array<int>>>",
    )
    with released(words.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)


def _listed(words: DataFrame, shares: int = 1) -> DataFrame:
    """share, packed: the words of a share's texts, as many rows of it as there are tasks, or more."""
    placed = words.where("id is not null").withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int"))
    if "words" in words.columns:
        placed = placed.select("share", "id", "words")
    else:
        placed = placed.where("term is not null").select("share", "id", "term", F.col("pos").cast("int").alias("pos"))
    return placed.mapInArrow(_by_share, "share int, packed binary")


def _by_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings or texts to a row per share, with its words packed, for about ``HELD_WORDS`` words at a time."""
    held, n = [], 0
    for batch in batches:
        for rows in _spread(batch) if "words" in batch.schema.names else [batch]:
            columns = [rows["share"], rows["id"].dictionary_encode(), rows["term"].dictionary_encode(), rows["pos"]]
            held.append(pa.RecordBatch.from_arrays(columns, ["share", "id", "term", "pos"]))
            n += rows.num_rows
            if n >= HELD_WORDS:
                yield _packed(held)
                held, n = [], 0
    if n:
        yield _packed(held)
    # Workers are used again by other tasks, and would keep what they once needed.
    held.clear()
    pa.default_memory_pool().release_unused()


def _packed(batches: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    """Words (share, id, term, pos) to the bytes of each share: positions as steps, which are small."""
    rows = pa.Table.from_batches(batches).unify_dictionaries()
    share, pos = rows["share"].to_numpy(), rows["pos"].to_numpy()
    (ids, text), (terms, code) = (coded(rows[c].combine_chunks()) for c in ("id", "term"))
    order = in_order(share)
    starts = np.flatnonzero(np.r_[True, np.diff(share[order]) != 0])
    packed = []
    for at in np.split(order, starts[1:]):
        batch = pa.RecordBatch.from_arrays(
            [_named(ids, text[at]), _named(terms, code[at]), pa.array(np.diff(pos[at], prepend=np.int32(0)))], ["id", "term", "step"]
        )
        packed.append(bytes_of(batch))
    return pa.RecordBatch.from_arrays([pa.array(share[order[starts]]), pa.array(packed, pa.binary())], ["share", "packed"])


def _named(values: pa.Array, codes: np.ndarray) -> pa.DictionaryArray:
    used, codes = used_of(codes, len(values))
    return pa.DictionaryArray.from_arrays(pa.array(codes), values.take(pa.array(used)))


def _by_block(block_texts: int) -> Callable[[pa.Table], pa.Table]:
    """The packed words of a share to one row per term and block of ``block_texts`` texts, by term."""

    def cut(share: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        parts = list(tables_of(share["packed"]))
        pos = np.concatenate([np.cumsum(part["step"].to_numpy(), dtype="i4") for part in parts])
        words = pa.concat_tables([part.select(["id", "term"]) for part in parts]).unify_dictionaries()
        (ids, text), (terms, code) = (coded(words[c].combine_chunks()) for c in ("id", "term"))
        del parts, words
        # A text is as long as its last indexed word is far.
        last = np.zeros(len(ids), "i4")
        np.maximum.at(last, text, pos)
        by_length = np.argsort(last, kind="stable")
        place = np.empty(len(ids), "i8")
        place[by_length] = np.arange(len(ids))
        # In order of term, text and position; these mostly fit one number.
        word = code * np.int64(len(ids)) + place[text]
        del code, text
        if len(terms) * len(ids) <= LARGEST:
            word = np.sort(word << 31 | pos)
            word, pos = word >> 31, (word & (2**31 - 1)).astype("i4")
        else:
            order = np.lexsort((pos, word))
            word, pos = word[order], pos[order]
        # Places at which another text's positions begin, and among these places those of another term or block.
        at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        code, text = np.divmod(word[at], len(ids))
        block = text // block_texts
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
        of_text, of_row = np.r_[at, len(pos)].astype("i4"), np.r_[first, len(at)].astype("i4")
        del word
        positions = pa.ListArray.from_arrays(of_text, pa.array(pos, pa.int32()))
        held = pa.StructArray.from_arrays([ids.take(pa.array(by_length[text])), positions], names=["id", "positions"])
        return pa.table({
            "term": terms.take(pa.array(code[first])),
            "block": pa.array(share["share"][0].as_py() * SHARE_BLOCKS + block[first], pa.int64()),
            "most": pa.array(np.maximum.reduceat(np.diff(of_text), first), pa.int32()),
            "n_texts": pa.array(np.diff(of_row), pa.int32()),
            "n_postings": pa.array(np.diff(of_text[of_row]), pa.int32()),
            "texts": pa.ListArray.from_arrays(of_row, held),
        })

    return cut


def terms_of(queries: DataFrame, query_column: str = "query", text_column: str = "text") -> DataFrame:
    """query, term: the distinct index words of query texts, each query once by its name."""
    words = queries.select(F.col(query_column).alias("query"), english_index(F.col(text_column)).alias("words"))
    return words.select("query", F.explode_outer("words").alias("term")).where("term is not null").distinct()


def keyword_topk_of(
    stored: DataFrame, terms: DataFrame, k: int, gone: DataFrame | None = None, first_blocks: int = FIRST_BLOCKS
) -> DataFrame:
    """The ``k`` texts ranking highest for each query: query, id, score, rank.

    ``stored`` are posting blocks as they were written, and ``terms`` has a row
    per query and term (``terms_of``); a text must hold all terms of a query.
    The same rows as ``keyword.keyword_topk`` over all postings. Texts whose id
    is in ``gone`` are passed over. Queries without terms have no hits.
    """
    return _Search(stored, terms, k, gone, first_blocks).hits()


def blocks_read(stored: DataFrame, terms: DataFrame, k: int, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """How much of the postings a search leaves out, per query: query, postings, in_blocks, read.

    ``postings`` are all of its terms, ``in_blocks`` those in blocks that hold
    all of its terms, and ``read`` those in blocks that are scored.
    """
    search = _Search(stored, terms, k, None, first_blocks)
    read = search.early_blocks().unionByName(search.open_blocks())
    whole = stored.select("term", "n_postings").groupBy("term").agg(F.sum("n_postings").alias("n_postings"))
    found = whole.join(search.asked, "term").groupBy("query").agg(F.sum("n_postings").alias("postings"))
    for blocks, name in ((search.blocks, "in_blocks"), (read, "read")):
        found = found.join(blocks.groupBy("query").agg(F.sum("n_postings").alias(name)), "query", "left")
    counts = (F.coalesce(c, F.lit(0)).alias(c) for c in ("in_blocks", "read"))
    return search.for_all(found.select("query", "postings", *counts))


class _Search:
    """The steps of one search; those that are read twice are stored.

    Queries of the same terms are searched once, as the first of them: there
    are far fewer sets of terms than queries, and every other step grows with
    the sets times the blocks.
    """

    def __init__(self, stored: DataFrame, terms: DataFrame, k: int, gone: DataFrame | None, first_blocks: int):
        self.stored, self.k, self.gone = stored, k, gone
        with released(stored.sparkSession):
            self._prepare(terms, first_blocks)

    def _prepare(self, terms: DataFrame, first_blocks: int) -> None:
        self.members = _members(terms)
        sets = self.members.where("query = first").select("query", "terms")
        self.asked = sets.select("query", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
        self.sets = sets
        words = kept(self.asked.select("term").distinct(), "words")
        #: The rows of asked terms are found where they lie, unless there are very many terms.
        self.words = F.broadcast(words) if words.count() <= SENT_TERMS else words
        self.blocks = kept(_candidates(self.rows("term", "block", "most", "n_postings"), self.asked), "blocks")
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
        early = self.blocks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first_blocks)
        self.early = kept(early.drop("place"), "early")
        self.first = kept(self.scored(self.early_blocks()), "first")

        reached = rank_hits(self.first, self.k, 0).where(F.col("rank") == self.k).select("query", F.col("score").alias("reached"))
        # The last block scored so far comes before all others of its query: one row per query tells them apart.
        last = F.max(F.struct(-F.col("bound"), "block")).alias("last")
        self.reached = kept(self.early.groupBy("query").agg(last).join(reached, "query", "left"), "reached")

    def hits(self) -> DataFrame:
        best = rank_hits(self.first.unionByName(self.scored(self.open_blocks())), self.k, 0)
        return self.for_all(best).select("query", "id", "score", "rank")

    def for_all(self, rows: DataFrame) -> DataFrame:
        """Rows of the queries that were searched, for every query of the same terms."""
        whole = self.members.select("query", "first").join(rows.withColumnRenamed("query", "first"), "first")
        return whole.drop("first")

    def rows(self, *columns: str) -> DataFrame:
        """Columns of the stored rows of asked terms."""
        return self.stored.select(*columns).join(self.words, "term", "left_semi")

    def early_blocks(self) -> DataFrame:
        return self.early.withColumn("reached", F.lit(None).cast("double"))

    def open_blocks(self) -> DataFrame:
        """The blocks not scored yet that can hold one of a query's ``k`` best."""
        rest = self.blocks.join(self.reached, "query").where(F.struct(-F.col("bound"), "block") > F.col("last"))
        return rest.where(_can_reach(F.col("bound"))).drop("last")

    def scored(self, blocks: DataFrame) -> DataFrame:
        """query, id, score of the texts with all terms in some (query, block) pairs, and that can reach a score.

        A block's postings and the queries that ask for it meet in one group of
        bounded size, so that positions are not handed on per query. They are
        packed for it, as on writing.
        """
        wanted = blocks.select("query", "block", "reached").join(self.sets, "query")
        rows = self.rows("block", "term", "texts")
        kinds = [x.dataType.simpleString() for x in (self.sets.schema["query"], rows.schema["texts"].dataType.elementType["id"])]
        packed = rows.select("block", "term", "texts").mapInArrow(_packed_blocks, "block long, packed binary")
        # Of texts that are taken away later, any number may stand before the k best.
        most = self.k if self.gone is None else None
        found = wanted.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(
            _scoring(most, to_arrow_type(rows.schema["texts"].dataType.elementType["id"].dataType)),
            f"query {kinds[0]}, id {kinds[1]}, reached double, score double",
        )
        if self.gone is not None:
            found = found.join(self.gone.select("id"), "id", "left_anti")
        found = found.withColumn("score", F.round("score", SCORE_DIGITS))
        return found.where("reached is null or score >= reached").select("query", "id", "score")


def _packed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored rows (block, term, texts) to a row per block, with its rows packed, for about ``HELD_WORDS`` texts at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch["texts"].flatten())
        if n >= HELD_WORDS:
            yield _packed_rows(held)
            held, n = [], 0
    if n:
        yield _packed_rows(held)
    held.clear()
    pa.default_memory_pool().release_unused()


def _packed_rows(batches: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    block = rows["block"].to_numpy()
    order = np.argsort(block, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0])
    packed = []
    for at in np.split(order, starts[1:]):
        packed.append(bytes_of(rows.select(["term", "texts"]).take(pa.array(at)).combine_chunks().to_batches()[0]))
    return pa.RecordBatch.from_arrays([pa.array(block[order[starts]]), pa.array(packed, pa.binary())], ["block", "packed"])


def _scoring(k: int | None, id_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The covers of the texts of a block that have all terms of a query (query, block, reached, terms): the ``k`` best and what draws level."""

    def score(wanted: pa.Table, packed: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        found = []
        if wanted.num_rows and packed.num_rows:
            block = _Block(pa.concat_tables(tables_of(packed["packed"])).combine_chunks())
            terms = wanted["terms"].combine_chunks()
            sizes = pc.list_value_length(terms).to_numpy()
            begins = np.cumsum(sizes) - sizes
            at = pc.fill_null(pc.index_in(terms.flatten(), block.terms), -1).to_numpy()
            reached = pc.fill_null(wanted["reached"], 0.0).to_numpy()
            for m in np.unique(sizes[sizes > 0]).tolist():
                of = np.flatnonzero(sizes == m)
                asked = at[begins[of][:, None] + np.arange(m)]
                whole = (asked >= 0).all(axis=1)
                of, asked = of[whole], asked[whole]
                for n in range(0, len(of), SETS):
                    few = of[n : n + SETS]
                    number, text, scores = block.best(asked[n : n + SETS], reached[few], k)
                    found.append((few[number], text, scores))
        if not found:
            none = {"query": wanted["query"].slice(0, 0), "id": pa.array([], id_type)}
            return pa.table(none | {"reached": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        number, text, scores = (np.concatenate(x) for x in zip(*found))
        number = pa.array(number)
        return pa.table({
            "query": wanted["query"].take(number), "id": block.ids.take(pa.array(text)),
            "reached": wanted["reached"].take(number), "score": pa.array(scores, pa.float64()),
        })

    return score


class _Block:
    """The rows (term, texts) of a block. An entry is a text of a row."""

    def __init__(self, rows: pa.Table):
        self.terms = rows["term"].combine_chunks()
        lists = rows["texts"].combine_chunks()
        flat = lists.flatten()
        ids = flat.field("id").dictionary_encode()
        self.ids, self.text = ids.dictionary, ids.indices.to_numpy()
        positions = flat.field("positions")
        self.pos, self.sizes = positions.flatten().to_numpy(), pc.list_value_length(positions).to_numpy()
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.entries = pc.list_value_length(lists).to_numpy()
        self.first = np.cumsum(self.entries) - self.entries

    def best(self, asked: np.ndarray, reached: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sets of as many terms each (a row of ``asked``): set, text, score of texts with all terms that can reach a score.

        Of each set these are the ``k`` best and what draws level with the last of them.
        """
        used, asked = np.unique(asked, return_inverse=True)
        asked = asked.reshape(len(reached), -1)
        entry = _ranges(self.first[used], self.entries[used])
        held = np.full((len(used), len(self.ids)), -1, "i4")
        held[np.repeat(np.arange(len(used)), self.entries[used]), self.text[entry]] = entry
        counts = np.where(held >= 0, self.sizes[held], 0)
        rarest = counts[asked[:, 0]]
        for t in range(1, asked.shape[1]):
            np.minimum(rarest, counts[asked[:, t]], out=rarest)
        # A text must hold all terms, and so many times that it can draw level.
        least = np.ceil((reached - 10.0**-SCORE_DIGITS) / (WORD_WEIGHT * asked.shape[1]) - 1e-9)
        number, text = np.nonzero(rarest >= np.maximum(least, 1)[:, None])
        entries = held[asked[number], text[:, None]]
        scores = np.empty(len(number))
        ends = np.cumsum(self.sizes[entries].sum(axis=1))
        # Pairs of a set and a text, about as many positions at a time as words are packed.
        for few in np.split(np.arange(len(number)), np.flatnonzero(np.diff(ends // HELD_POSITIONS)) + 1):
            scores[few] = self.scores(entries[few])
        level = scores >= reached[number] - 10.0**-SCORE_DIGITS
        number, text, scores = number[level], text[level], scores[level]
        if k is not None and len(number):
            order = np.lexsort((-scores, number))
            number, text, scores = number[order], text[order], scores[order]
            starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            sizes = np.diff(np.r_[starts, len(number)])
            last = scores[starts + np.minimum(sizes, k) - 1]
            level = scores >= np.repeat(np.where(sizes < k, 0, last - 10.0**-SCORE_DIGITS), sizes)
            number, text, scores = number[level], text[level], scores[level]
        return number, text, scores

    def scores(self, entries: np.ndarray) -> np.ndarray:
        """The score of each row: the entries of a text, one for each term."""
        sizes = self.sizes[entries]
        pos = self.pos[_ranges(self.begins[entries].ravel(), sizes.ravel())]
        row = np.repeat(np.arange(len(entries)), sizes.sum(axis=1))
        term = np.repeat(np.tile(np.arange(entries.shape[1]), len(entries)), sizes.ravel())
        return _cover_scores(row, pos, term, entries.shape[1], len(entries))


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def _cover_scores(text: np.ndarray, pos: np.ndarray, term: np.ndarray, n_terms: int, n_texts: int) -> np.ndarray:
    """``keyword.score_covers`` for the positions of one query's terms in some texts, before rounding."""
    if n_texts * n_terms <= LARGEST:
        word = np.sort((text << 31 | pos) * n_terms + term)
        word, term = np.divmod(word, n_terms)
        text, pos = word >> 31, word & (2**31 - 1)
    else:
        order = np.lexsort((term, pos, text))
        text, pos, term = text[order], pos[order], term[order]
    at = np.arange(len(text))
    begins = np.maximum.accumulate(np.where(np.r_[True, text[1:] != text[:-1]], at, 0))
    start = at
    for t in range(n_terms):
        start = np.minimum(start, np.maximum.accumulate(np.where(term == t, at, -1)))
    complete = start >= begins
    # A span is a shortest one unless the span before it had the same start.
    cover = complete & np.r_[True, (start[1:] > start[:-1]) | ~complete[:-1]]
    stop, start = at[cover], start[cover]
    others = (pos[stop] - pos[start]) - (stop - start)
    return np.bincount(text[stop], WORD_WEIGHT / (1 + others), minlength=n_texts)


def _bound() -> Column:
    """The most a text can score by ``n_terms`` and the occurrences of its ``rarest`` term."""
    return F.lit(WORD_WEIGHT) * F.col("n_terms") * F.col("rarest")


def _can_reach(bound: Column) -> Column:
    # Scores are rounded; equal ones are ranked by id, so what can draw level counts.
    return F.col("reached").isNull() | (bound + 10.0**-SCORE_DIGITS >= F.col("reached"))


def _members(terms: DataFrame) -> DataFrame:
    """query, terms, first: each query with its terms in order and the first query that has the same."""
    whole = terms.select("query", "term").where("query is not null and term is not null").groupBy("query").agg(
        F.sort_array(F.collect_set("term")).alias("terms")
    )
    whole = kept(whole, "terms")
    sets = whole.groupBy("terms").agg(F.min("query").alias("first"))
    return kept(whole.join(sets, "terms"), "members")


def _candidates(bounds: DataFrame, asked: DataFrame) -> DataFrame:
    """query, block, n_postings, bound: the blocks that hold all terms of a query."""
    whole = bounds.join(asked, "term").groupBy("query", "block").agg(
        F.max("n_terms").alias("n_terms"), F.count(F.lit(1)).alias("found"), F.min("most").alias("rarest"),
        F.sum("n_postings").alias("n_postings"),
    ).where("found = n_terms")
    return whole.select("query", "block", "n_postings", _bound().alias("bound"))
