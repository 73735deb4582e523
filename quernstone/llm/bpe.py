"""Byte-level BPE by speculation: longest matches, checked pair by pair, and exact merging of the words that fail."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text

VOCABULARY = "byte_bpe_50k.json"
#: Words that are resolved together, and words whose ids a worker holds.
BLOCK_WORDS = 100_000
HELD_WORDS = 150_000
#: A long text is worked on in parts of about so many characters; words of more bytes are merged one by one.
BLOCK_CHARS, TOGETHER_BYTES = 1_000_000, 64
#: Fixed value: how byte-level vocabularies of this family cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The Unicode tables of ``regex`` and of the tokenizers library agree on these code points; texts with
#: others (the two differ on letters added lately) are cut by the library's own pre-tokenizer.
_AGREED = re.compile("[\x00-՗ೝ-₎]*")
_JOINED = re.compile(r"\s ")
_NEVER = np.int64(2**40)
_WIDTH = 2**32


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in such a vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _by_owner(flat: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    """The packed ids of each owner, from ids sorted by owner."""
    data = _packed(flat)
    ends = (4 * np.cumsum(np.bincount(owner, minlength=n))).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class ByteBpe:
    """A byte-level BPE vocabulary of the tokenizers library, and texts to ids and back.

    Merges have an order; a word's ids are what is left when the first possible
    merge, and of equal ones the leftmost, is made until none is possible.

    * Proposal: from left to right the longest token that the word goes on with.
    * Check: ids are a word's own exactly when each token is what its bytes
      merge to, and no merge would have crossed the border of two neighbours.
      Seen backwards in time, the later made of the two is taken apart at the
      border, until single bytes meet; a merge across that comes before the
      next one of the two sides forbids the pair. All pairs of a block of words
      take these steps together, as arrays.
    * Words with a forbidden pair are merged exactly.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        )
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        if spec.get("normalizer") or not cut.get("use_regex", True):
            raise ValueError(f"{path} changes texts before they are cut")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens that look at what is around them")
        self._cutter = Tokenizer.from_file(path).pre_tokenizer
        self._words = regex.compile(PATTERN)
        self._added = {t["content"]: t["id"] for t in added}
        names = sorted(self._added, key=len, reverse=True)
        self._between = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

        self.bytes_of = _token_bytes(spec)
        size = max(self.bytes_of) + 1
        self.order = np.zeros(size, np.int64)
        self.first, self.second = np.zeros(size, np.int64), np.zeros(size, np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        for place, (a, b) in enumerate(merges, 1):
            left, right, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if self.order[made] or max(self.order[left], self.order[right]) >= place:
                raise ValueError(f"{path} makes a token twice or before its parts")
            self.order[made], self.first[made], self.second[made] = place, left, right
            self._merge[left, right] = place, made
        self._made = np.array([0, *(made for _, made in self._merge.values())], np.int64)
        pairs = sorted((left * _WIDTH + right, place) for (left, right), (place, _) in self._merge.items())
        self._pairs, self._places = np.array(pairs, np.int64).reshape(-1, 2).T
        self._byte = {self.bytes_of[i][0]: i for i in model["vocab"].values() if len(self.bytes_of[i]) == 1}

        self._by_byte = np.array([self._byte[b] for b in range(256)], np.int64)

        whole = self._canonical()
        self._token = {self.bytes_of[i]: i for i in model["vocab"].values() if whole[i]}
        self._plant()
        # The longest token by its first two bytes, and by its first alone.
        self._longest: dict[bytes, int] = {}
        for token in self._token:
            for start in (token[:1], token[:2]):
                self._longest[start] = max(self._longest.get(start, 1), len(token))
        self._held: dict[str | tuple | int, bytes] = {}
        self._older: dict[str | tuple | int, bytes] = {}

    def _canonical(self) -> np.ndarray:
        """Of each token, whether its own bytes merge to it."""
        made = np.flatnonzero(self.order)
        whole = np.ones(len(self.order), bool)
        whole[made] = self.compatible(self.first[made], self.second[made], self.order[made])
        for i in made[np.argsort(self.order[made])]:
            whole[i] = whole[i] and whole[self.first[i]] and whole[self.second[i]]
        return whole

    def _across(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The order of the merge of two tokens; very late where there is none."""
        if not len(self._pairs):
            return np.full(len(left), _NEVER)
        key = left * _WIDTH + right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._places[at], _NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Of neighbouring tokens: whether no merge crosses their border (earlier than ``before``, where given)."""
        fine = np.ones(len(left), bool)
        at = np.arange(len(left))
        limit = np.full(len(left), _NEVER) if before is None else before
        while len(at):
            crossed = self._across(left, right) < limit
            fine[at[crossed]] = False
            a, b = self.order[left], self.order[right]
            # Of two tokens of one order the left one was made first.
            undo_left = a > b
            on = ~crossed & ((a > 0) | (b > 0))
            limit = np.where(undo_left, a, b + 1)[on]
            left, right = np.where(undo_left, self.second[left], left)[on], np.where(undo_left, right, self.first[right])[on]
            at = at[on]
        return fine

    def propose(self, word: bytes) -> list[int]:
        """Longest tokens from left to right."""
        out, at, n = [], 0, len(word)
        token, longest = self._token, self._longest
        while at < n:
            reach = longest.get(word[at : at + 2], 1)
            for end in range(min(n, at + reach), at, -1):
                found = token.get(word[at:end])
                if found is not None:
                    out.append(found)
                    at = end
                    break
        return out

    def _plant(self) -> None:
        """The tokens as a tree of bytes: sorted keys ``node * 256 + byte``, where each leads, and the token of a node."""
        children: dict[int, int] = {}
        ends = {}
        for token, i in self._token.items():
            node = 0
            for byte in token:
                node = children.setdefault(node * 256 + byte, len(children) + 1)
            ends[node] = i
        self._steps = np.array(sorted(children), np.int64)
        self._leads = np.array([children[k] for k in self._steps.tolist()], np.int64)
        self._ends = np.full(len(children) + 1, -1, np.int64)
        self._ends[list(ends)] = list(ends.values())

    def propose_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``propose`` for many words, each a token at a time: the ids, and which word each belongs to."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        owner = np.arange(len(words))
        at = np.r_[0, stop[:-1]]
        found = []
        while len(owner):
            best, reached = np.full(len(owner), -1), at.copy()
            alive = np.arange(len(owner))
            node, place = np.zeros(len(owner), np.int64), at.copy()
            while len(alive):
                key = node * 256 + data[place]
                step = np.minimum(np.searchsorted(self._steps, key), len(self._steps) - 1)
                on = self._steps[step] == key
                alive, node, place = alive[on], self._leads[step[on]], place[on] + 1
                token = self._ends[node]
                met = token >= 0
                best[alive[met]], reached[alive[met]] = token[met], place[met]
                inside = place < stop[owner[alive]]
                alive, node, place = alive[inside], node[inside], place[inside]
            found.append((owner, best))
            more = reached < stop[owner]
            owner, at = owner[more], reached[more]
        owner, ids = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def merge(self, word: bytes) -> list[int]:
        """A word's ids by merging: a queue of the possible merges over a chain of tokens."""
        ids = [self._byte[b] for b in word]
        n = len(ids)
        after, ahead = [*range(1, n + 1)], [*range(-1, n - 1)]
        merges = self._merge
        queue = [(*merges[pair][:1], k, *pair) for k, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
        heapq.heapify(queue)
        while queue:
            _, k, a, b = heapq.heappop(queue)
            other = after[k]
            if ids[k] != a or other >= n or ids[other] != b:
                continue
            ids[k], ids[other] = merges[a, b][1], -1
            after[k] = after[other]
            if after[k] < n:
                ahead[after[k]] = k
            for start in (ahead[k], k):
                if start >= 0 and after[start] < n:
                    pair = ids[start], ids[after[start]]
                    if pair in merges:
                        heapq.heappush(queue, (merges[pair][0], start, *pair))
        return [i for i in ids if i >= 0]

    def merge_together(self, words: list[bytes]) -> list[bytes]:
        """The ids of many words by merging: in each round, every word makes its first merge."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = self._by_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        while len(flat):
            places = np.full(len(flat), _NEVER)
            places[:-1] = np.where(owner[1:] == owner[:-1], self._across(flat[:-1], flat[1:]), _NEVER)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(flat)])
            least = np.minimum.reduceat(places, starts)
            # Words without a merge are done.
            going = np.repeat(least < _NEVER, lengths)
            ends.append((owner[~going], flat[~going]))
            hits = np.flatnonzero((places == np.repeat(least, lengths)) & going)
            hits = hits[np.r_[True, owner[hits][1:] != owner[hits][:-1]]] if len(hits) else hits
            flat[hits] = self._made[places[hits]]
            going[hits + 1] = False
            flat, owner = flat[going], owner[going]
        owner, flat = (np.concatenate(x) for x in zip(*ends))
        by_word = np.argsort(owner, kind="stable")
        return _by_owner(flat[by_word], owner[by_word], len(words))

    def resolve(self, words: list[bytes]) -> tuple[list, int]:
        """The packed ids of words, and how many of the words had to be merged."""
        short = [k for k, w in enumerate(words) if 0 < len(w) <= TOGETHER_BYTES]
        out: list = [b""] * len(words)
        fails = self._settle(out, short, words) if short else 0
        for k, word in enumerate(words):
            if len(word) > TOGETHER_BYTES:
                ids = np.array(self.propose(word))
                passes = self.compatible(ids[:-1], ids[1:]).all()
                out[k] = _packed(ids if passes else self.merge(word))
                fails += not passes
        return out, fails

    def _settle(self, out: list, places: list[int], words: list[bytes]) -> int:
        """Write the ids of the words at some places into ``out``; the number of words that failed."""
        words = [words[k] for k in places]
        flat, owner = self.propose_together(words)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        failed = np.zeros(len(words), bool)
        failed[owner[inside[~self.compatible(flat[inside], flat[inside + 1])]]] = True
        proposed = _by_owner(flat, owner, len(words))
        for k, ids in enumerate(proposed):
            out[places[k]] = ids
        again = np.flatnonzero(failed).tolist()
        if again:
            for k, ids in zip(again, self.merge_together([words[k] for k in again])):
                out[places[k]] = ids
        return len(again)

    def cut(self, text: str) -> Iterator[str]:
        """The words of a text without added tokens, in order."""
        if _AGREED.fullmatch(text):
            return (m.group() for m in self._words.finditer(text))
        return (text[a:b] for _, (a, b) in self._cutter.pre_tokenize_str(text))

    def chunks(self, text: str) -> Iterator[list[str | tuple | int]]:
        """A text in blocks of chunks that are cut independently, and the ids of added tokens that stand in it.

        A single space between other characters always starts a word, so what
        stands between such spaces recurs from text to text. A part of a text
        with white space before a space is cut into its words at once.
        """
        for part in self._between.split(text) if self._between else [text]:
            if part in self._added:
                yield [self._added[part]]
            elif _JOINED.search(part) or not _AGREED.fullmatch(part):
                words = self.cut(part)
                # Kept apart from chunks, which are still to be cut.
                while block := [(w,) for w in islice(words, BLOCK_WORDS)]:
                    yield block
            else:
                start = 0
                while start < len(part):
                    end = part.find(" ", start + BLOCK_CHARS)
                    end = len(part) if end < 0 else end
                    first, *rest = part[start:end].split(" ")
                    # A block after the first starts with its space.
                    yield [first] * bool(first) + [" " + r for r in rest]
                    start = end

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        waiting: list[tuple[list[str | tuple | int], bool]] = []
        size, started = 0, bytearray()
        for text in texts:
            for block in self.chunks(text):
                waiting.append((block, False))
                size += len(block)
                if size >= BLOCK_WORDS:
                    yield from self._joined(waiting, started)
                    waiting, size = [], 0
            waiting.append(([], True))
        yield from self._joined(waiting, started)

    def _joined(self, waiting: list[tuple[list[str | tuple | int], bool]], started: bytearray) -> Iterator[bytes]:
        """The ids of texts that end here; of one that goes on they are kept in ``started``."""
        wanted = set().union(*(block for block, _ in waiting))
        if len(self._held) + len(wanted) > HELD_WORDS:
            # What is asked for again is taken over, so that frequent chunks stay.
            self._older, self._held = self._held, {}
        held, older = self._held, self._older
        new = []
        for chunk in wanted:
            if chunk not in held:
                if chunk in older:
                    held[chunk] = older[chunk]
                else:
                    new.append(chunk)
        held.update((i, _packed([i])) for i in new if isinstance(i, int))
        cut = self._words.findall
        # Letters, with or without a space before them, are a word.
        whole = [c for c in new if isinstance(c, str) and c.removeprefix(" ").isalpha()]
        parts = {c: cut(c) for c in set(new).difference(whole) if isinstance(c, str)}
        parts |= {c: c for c in new if isinstance(c, tuple)}
        words = list(set(whole).union(*parts.values()))
        ids = dict(zip(words, self.resolve([w.encode() for w in words])[0]))
        held.update((c, ids[c]) for c in whole)
        held.update((c, b"".join([ids[w] for w in found])) for c, found in parts.items())
        for block, last in waiting:
            started += b"".join(map(held.__getitem__, block))
            if last:
                yield bytes(started)
                started.clear()

    def decode(self, ids: bytes) -> str:
        return decoded(ids, self.bytes_of)


def _token_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes of each token of a vocabulary file's content; added tokens stand for their names."""
    stands_for = byte_characters()
    tokens = {i: bytes(map(stands_for.__getitem__, token)) for token, i in spec["model"]["vocab"].items()}
    return tokens | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}


def decoded(ids: bytes, tokens: dict[int, bytes]) -> str:
    """The text of little-endian 32-bit ids. Unknown ids are left out; bytes that are no UTF-8 become U+FFFD."""
    numbers = np.frombuffer(ids, "<u4").tolist()
    return b"".join([tokens.get(i, b"") for i in numbers]).decode("utf-8", "replace")


def _path_of(name: str) -> str:
    """A file of the public tokenizers, or the path given."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def vocabulary_of(name: str) -> ByteBpe:
    """The vocabulary in a file of the public tokenizers, or at a path, read once per worker."""
    return ByteBpe(_path_of(name))


@lru_cache(maxsize=4)
def tokens_of(name: str) -> dict[int, bytes]:
    """The bytes of a vocabulary's tokens alone, all that decoding needs."""
    with open(_path_of(name), encoding="utf-8") as file:
        return _token_bytes(json.load(file))


def encode_documents(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """The token ids of each whole text: ``id, n_tokens, ids``, the ids packed as little-endian 32-bit numbers.

    ``vocabulary`` names a file of the public tokenizers or a path that all
    executors can open. The ids are those of the tokenizers library without
    special tokens added; names of special tokens that stand in a text become
    their ids, as there. Null and empty texts have no ids. Each row given is a
    row, repeated ones and those without id too; no rows give no rows, and
    other columns are not read. Long texts are worked on in blocks of words.
    """
    kind = documents.schema[id_column].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary_of(vocabulary)
        for batch in batches:
            ids = list(bpe.encode(t.as_py() for t in batch.column(1)))
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), counts, pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"]
            )

    rows = documents.select(F.col(id_column).alias("id"), plain_text(text_column).alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ids_column: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``decoded``, the text of packed ids, with the names of special tokens; null ids give an empty text."""
    names, kinds = zip(*encoded.dtypes)
    at = names.index(ids_column)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(vocabulary)
        for batch in batches:
            texts = [decoded(i.as_py() or b"", tokens) for i in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    fields = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    return encoded.mapInArrow(decode, f"{fields}, decoded string")
