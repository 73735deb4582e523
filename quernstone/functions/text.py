"""Text functions: chunking, titles, tokens and English stems."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 1000
OVERLAP_CHARS = 100
#: Rows of an Arrow batch that are Python objects at one time.
SLICE_ROWS = 256


def split_text(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Overlapping pieces of one text, cut after a sentence or line where possible.

    A text that fits is returned as it is. Every cut moves forward by at least
    ``size * 4/5 - overlap`` characters, and the last piece is the one that
    reaches the end of the text.
    """
    if len(text) <= size:
        return [text]
    search_from = size * 4 // 5 + 1
    pieces, start = [], 0
    while start + size < len(text):
        low, end = start + search_from, start + size
        cut = max(text.rfind(mark, low, end) for mark in (". ", "! ", "? ", "\n"))
        if cut >= 0:
            end = cut + 1
        pieces.append(text[start:end])
        start = end - overlap
    pieces.append(text[start:])
    return [piece for piece in (p.strip() for p in pieces) if piece]


def by_slices(column: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """What ``work`` makes of an Arrow column, worked out for ``SLICE_ROWS`` rows at a time.

    Only the column and the result are held whole, not the Python objects between them.
    """
    return pa.concat_arrays([work(column.slice(at, SLICE_ROWS)) for at in range(0, max(1, len(column)), SLICE_ROWS)])


def chunk_text(text: Column | str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """``array<string>`` of the chunks of a text.

    Each cut depends on the one before, so this is a fold. As a Catalyst
    ``aggregate`` it measured ten times slower than this Arrow batch function
    (and walks the UTF-8 text from its start at every step).
    """
    if not 0 <= overlap < size * 4 // 5:
        raise ValueError("overlap must be shorter than four fifths of the chunk size")

    def split_rows(texts: pa.Array) -> pa.Array:
        return pa.array(
            [None if t is None else split_text(t, size, overlap) for t in texts.to_pylist()],
            type=pa.list_(pa.string()),
        )

    def split_batch(texts: pa.Array) -> pa.Array:
        return by_slices(texts, split_rows)

    return F.arrow_udf(split_batch, "array<string>")(text)


def document_title(text: Column, source_path: Column) -> Column:
    """First level-one markdown heading, else the last segment of the path."""
    # With (?d), only a line feed ends a line.
    heading = F.regexp_extract(text, r"(?md)^#\s+(.+)$", 1)
    return F.coalesce(F.nullif(heading, F.lit("")), F.element_at(F.split(source_path, "/"), -1))


def word_tokens(text: Column) -> Column:
    """``array<string>`` of the lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# The English stop words of the PostgreSQL text search configuration.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()
_STOP_SET = frozenset(STOP_WORDS)

# The published Snowball English ("Porter2") stemmer.
# Word -> stem for the irregular words, and words left alone after step 1a.
STEM_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
STEM_FINAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_1B = ("eedly", "ingly", "edly", "eed", "ing", "ed")
# Suffix, replacement, letters that must come before it. Step 2 and 3 act in region 1, step 4 in region 2.
STEP_2 = (
    ("ational", "ate", ""), ("fulness", "ful", ""), ("iveness", "ive", ""), ("ization", "ize", ""),
    ("ousness", "ous", ""), ("biliti", "ble", ""), ("lessli", "less", ""), ("tional", "tion", ""),
    ("alism", "al", ""), ("aliti", "al", ""), ("ation", "ate", ""), ("entli", "ent", ""), ("fulli", "ful", ""),
    ("iviti", "ive", ""), ("ousli", "ous", ""), ("abli", "able", ""), ("alli", "al", ""), ("anci", "ance", ""),
    ("ator", "ate", ""), ("enci", "ence", ""), ("izer", "ize", ""), ("bli", "ble", ""), ("ogi", "og", "l"),
    ("li", "", "cdeghkmnrt"),
)
STEP_3 = (
    ("ational", "ate", ""), ("tional", "tion", ""), ("alize", "al", ""), ("icate", "ic", ""), ("iciti", "ic", ""),
    ("ative", "", ""), ("ical", "ic", ""), ("ness", "", ""), ("ful", "", ""),
)
STEP_4 = (
    ("ement", "", ""), ("ance", "", ""), ("ence", "", ""), ("able", "", ""), ("ible", "", ""), ("ment", "", ""),
    ("ant", "", ""), ("ent", "", ""), ("ism", "", ""), ("ate", "", ""), ("iti", "", ""), ("ous", "", ""),
    ("ive", "", ""), ("ize", "", ""), ("ion", "", "st"), ("al", "", ""), ("er", "", ""), ("ic", "", ""),
)
# Regular expressions of the same definition; Y marks a y that is a consonant.
REGION_1 = "(gener|commun|arsen|.*?[aeiouy][^aeiouy])"
REGION_2 = "(.*?[aeiouy][^aeiouy])"
HAS_VOWEL = "[aeiouy]"
SHORT_SYLLABLE = "[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$"
DOUBLED = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_REGION_1, _REGION_2 = re.compile(REGION_1), re.compile(REGION_2)
_SUFFIXES_2, _SUFFIXES_3, _SUFFIXES_4 = (tuple(rule[0] for rule in step) for step in (STEP_2, STEP_3, STEP_4))


def english_stem(word: str) -> str:
    """Stem of one lower-cased word. Words with digits and short words are their own stems."""
    if len(word) <= 2 or not word.isalpha():
        return word
    if word in STEM_IRREGULAR:
        return STEM_IRREGULAR[word]
    w = word
    if "y" in w:
        w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", w))
    region = _REGION_1.match(w)
    r1 = region.end() if region else len(w)
    region = _REGION_2.match(w, r1)
    r2 = region.end() if region else len(w)

    # 1a: endings in s.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(HAS_VOWEL, w[:-2]):
        w = w[:-1]
    if w in STEM_FINAL:
        return w

    # 1b: -eed, -ed and -ing.
    ending = next((e for e in STEP_1B if w.endswith(e)), "") if w.endswith(STEP_1B) else ""
    if ending:
        base = w[: -len(ending)]
        if ending.startswith("eed"):
            w = base + "ee" if len(base) >= r1 else w
        elif re.search(HAS_VOWEL, base):
            if base.endswith(("at", "bl", "iz")):
                w = base + "e"
            elif base.endswith(DOUBLED):
                w = base[:-1]
            elif len(base) <= r1 and re.search(SHORT_SYLLABLE, base):
                w = base + "e"
            else:
                w = base

    # 1c, then the three suffix tables.
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for rules, suffixes, start in ((STEP_2, _SUFFIXES_2, r1), (STEP_3, _SUFFIXES_3, r1), (STEP_4, _SUFFIXES_4, r2)):
        if not w.endswith(suffixes):
            continue
        for suffix, replacement, before in rules:
            if w.endswith(suffix):  # the longest suffix decides, whether or not it may go
                base = w[: -len(suffix)]
                limit = r2 if suffix == "ative" else start
                if len(base) >= limit and (not before or (base and base[-1] in before)):
                    w = base + replacement
                break

    # 5: final e and l.
    last = len(w) - 1
    if w.endswith("e"):
        if last >= r2 or (last >= r1 and not re.search(SHORT_SYLLABLE, w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and last >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def index_words(words: Column) -> Column:
    """``array<string>`` of the same length: stems, and null where a stop word stood.

    Every distinct word of an Arrow batch is stemmed once; putting the stems
    back in place is a vectorised ``take``.
    """

    def stem_batch(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        stems = pa.array(
            [None if w is None or w in _STOP_SET else english_stem(w) for w in flat.dictionary.to_pylist()],
            type=pa.string(),
        )
        values = stems.take(flat.indices)
        # flatten() leaves out null lists, so lengths rather than raw offsets rebuild the column.
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]), pa.int32())
        return pa.ListArray.from_arrays(offsets, values, mask=pc.is_null(lists))

    return F.arrow_udf(stem_batch, "array<string>")(words)


def english_index(text: Column) -> Column:
    """``array<string>`` of the words of an English text by position: stems, and null for stop words."""
    return index_words(word_tokens(text))


def explode_index(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """One row per indexed word: the key columns, ``term`` and its 1-based ``pos``. Narrow: no shuffle."""
    # The outer form: from the plain one Spark infers a filter on the array's size below it,
    # and would run the batch function that makes the array once more for that.
    words = df.select(*keys, F.posexplode_outer(index).alias("__at", "term"))
    return words.where("term is not null").select(*keys, "term", (F.col("__at") + 1).alias("pos"))
