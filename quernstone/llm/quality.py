"""Quality rules of documents, with boilerplate found by line frequency within a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, plain_text, stored, words_of

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A line is boilerplate in a host where it stands in so many different texts, and in that share of them.
MIN_TEXTS = 20
MIN_PERCENT = 5
#: A document is depleted when its host's boilerplate makes up more than this share of its words.
MAX_REMOVED_PERCENT = 50
WINDOW = 3


def _repeated_words(df: DataFrame) -> DataFrame:
    """``n_repeat_words`` from ``words``: those in windows that the text holds twice or more.

    Windows are sorted by hash with their places, so equal ones meet; each
    repeated window then covers what lies before the next one, three words at most.
    """
    n = F.size("words") - (WINDOW - 1)
    windows = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))).alias("h"), i.alias("i")),
    )
    df = df.withColumn("windows", F.when(n > 0, windows))
    df = df.withColumn("distinct", F.size(F.array_distinct("windows.h")))
    df = df.withColumn("sorted", F.when(F.col("distinct") < F.size("windows"), F.sort_array("windows")))

    def met(window: Column, j: Column) -> Column:
        same = lambda k: F.coalesce(F.get("sorted", k)["h"] == window["h"], F.lit(False))
        return same(j - 1) | same(j + 1)

    df = df.withColumn("places", F.sort_array(F.transform(F.filter("sorted", met), lambda w: w["i"])))
    covered = F.transform(
        "places",
        lambda place, j: F.least(F.lit(WINDOW), F.coalesce(F.get("places", j + 1) - place, F.lit(WINDOW))),
    )
    total = F.aggregate(covered, F.lit(0), lambda a, b: a + b)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop(
        "windows", "distinct", "sorted", "places"
    )


def text_measures(documents: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """Counts of each document beside its id, its host and two hashes of its text."""
    text = plain_text(text_column)
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    base = documents.select(
        F.col(id_column).alias("id"),
        F.col(host_column).cast("string").alias("host"),
        text.alias("text"),
        words_of(text).alias("words"),
    ).withColumn("lines", lines)
    measured = _repeated_words(base)
    return measured.select(
        "id",
        "host",
        F.xxhash64("text").alias("k1"),
        F.xxhash64(F.lit(1), "text").alias("k2"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def depleted_texts(
    documents: DataFrame,
    text_column: str = "text",
    host_column: str = "source",
    min_texts: int = MIN_TEXTS,
    min_percent: int = MIN_PERCENT,
) -> DataFrame:
    """What a host's boilerplate takes from its texts: ``host, k1, k2, n_removed, gone``.

    ``n_removed`` counts words, ``gone`` are the hashes of the lines. A line is boilerplate where at least ``min_texts`` different texts of the
    host hold it, and at least ``min_percent`` of a hundred. Texts without such
    lines are not listed. A null host is a host of its own.
    """
    lines = stored(_distinct_lines(documents, text_column, host_column), "lines")
    sizes = lines.groupBy("host").agg(F.sum("head").alias("texts"))
    counts = lines.where("words > 0").groupBy("host", "line").agg(F.count(F.lit(1)).alias("found"))
    counts = counts.where(F.col("found") >= min_texts)
    sizes = sizes.withColumnRenamed("host", "sized_host")
    common = counts.join(sizes, F.col("host").eqNullSafe(F.col("sized_host")))
    common = common.where(F.col("found") * 100 >= F.col("texts") * min_percent).select(
        F.col("host").alias("common_host"), F.col("line").alias("common_line")
    )
    same = F.col("host").eqNullSafe(F.col("common_host")) & (F.col("line") == F.col("common_line"))
    hits = lines.join(common, same, "left_semi")
    return hits.groupBy("host", "k1", "k2").agg(
        F.sum("words").alias("n_removed"), F.collect_set("line").alias("gone")
    )


def _flat_line(line: Column) -> Column:
    """A line as it is compared: single spaces, none at its ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))


def _distinct_lines(documents: DataFrame, text_column: str, host_column: str) -> DataFrame:
    text = plain_text(text_column)
    lines = documents.select(
        F.col(host_column).cast("string").alias("host"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(1), text).alias("k2"),
        F.posexplode(F.split(text, "\n")).alias("place", "raw"),
    ).select("host", "k1", "k2", "place", _flat_line(F.col("raw")).alias("flat"))
    spaces = F.length("flat") - F.length(F.replace("flat", F.lit(" "), F.lit("")))
    # Rows that hold the same text give the same (place, line) again, so each place is counted once.
    places = lines.select(
        "host", "k1", "k2", "place",
        F.xxhash64("flat").alias("line"),
        F.when(F.col("flat") == "", 0).otherwise(spaces + 1).cast("long").alias("n"),
    ).where("n > 0 OR place = 0")
    return (
        places.groupBy("host", "line", "k1", "k2")
        .agg(F.max("n").alias("n"), F.collect_set("place").alias("places"))
        .select(
            "host", "line", "k1", "k2",
            (F.col("n") * F.size("places")).alias("words"),
            F.array_contains("places", 0).cast("int").alias("head"),
        )
    )


def quality_rules(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT,
    min_texts: int = MIN_TEXTS,
    min_percent: int = MIN_PERCENT,
    max_removed_percent: int = MAX_REMOVED_PERCENT,
) -> DataFrame:
    """Measures of each document and whether it is kept.

    Returns ``id, host, k1, k2`` (two hashes of the text), the counts
    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``,
    ``n_removed`` (words on lines that are boilerplate in its host, see
    ``depleted_texts``), ``base_failed`` and ``kept``: not failed, and not more
    than ``max_removed_percent`` of its words removed.

    A row per row given. Null and empty texts have no words and fail. Repeated
    rows are judged alike, and count as one text. A null host is a host of its
    own. No rows give no rows; other columns are not read. Only column
    expressions, joins and groupings are used.
    """
    judged = _judged(
        documents, id_column, text_column, host_column, min_words, max_repeated_percent, min_texts, min_percent,
        max_removed_percent,
    )
    return judged.drop("gone")


def _judged(
    documents: DataFrame,
    id_column: str,
    text_column: str,
    host_column: str,
    min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT,
    min_texts: int = MIN_TEXTS,
    min_percent: int = MIN_PERCENT,
    max_removed_percent: int = MAX_REMOVED_PERCENT,
) -> DataFrame:
    """The rows of ``quality_rules`` and ``gone``, the hashes of their boilerplate lines (null where there are none)."""
    measures = text_measures(documents, id_column, text_column, host_column)
    removed = depleted_texts(documents, text_column, host_column, min_texts, min_percent)
    removed = removed.withColumnsRenamed({"host": "removed_host", "k1": "removed_k1", "k2": "removed_k2"})
    same = (
        F.col("host").eqNullSafe(F.col("removed_host"))
        & (F.col("k1") == F.col("removed_k1"))
        & (F.col("k2") == F.col("removed_k2"))
    )
    joined = measures.join(removed, same, "left").drop("removed_host", "removed_k1", "removed_k2")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words"))
    depleted = 100 * F.col("n_removed") > max_removed_percent * F.col("n_words")
    return (
        joined.withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )


def kept_documents(documents: DataFrame, text_column: str = "text", host_column: str = "source", **options) -> DataFrame:
    """The documents that ``quality_rules`` keeps, without the lines that are boilerplate in their host.

    Columns are as given; ``n_chars``, where there is one, is counted anew for
    texts that lose lines. Other lines stay as they are, joined by line feeds.
    """
    judged = _judged(documents, documents.columns[0], text_column, host_column, **options)
    # The verdict and the lines hang on host and text alone; most texts are kept whole and need no row.
    touched = judged.where(~F.col("kept") | F.col("gone").isNotNull())
    touched = touched.groupBy("host", "k1", "k2").agg(F.first("kept").alias("__q_kept"), F.first("gone").alias("__q_gone"))
    touched = touched.withColumnsRenamed({"host": "__q_host", "k1": "__q_k1", "k2": "__q_k2"})
    text = plain_text(documents[text_column])
    same = (
        documents[host_column].cast("string").eqNullSafe(F.col("__q_host"))
        & (F.xxhash64(text) == F.col("__q_k1"))
        & (F.xxhash64(F.lit(1), text) == F.col("__q_k2"))
    )
    joined = documents.join(touched, same, "left").where(F.coalesce("__q_kept", F.lit(True)))
    stays = lambda line: ~F.array_contains("__q_gone", F.xxhash64(_flat_line(line)))
    left = F.array_join(F.filter(F.split(text, "\n"), stays), "\n")
    changed = F.col("__q_gone").isNotNull()
    joined = joined.withColumn("__q_text", F.when(changed, left))
    columns = {text_column: F.coalesce(F.col("__q_text"), F.col(text_column))}
    if "n_chars" in documents.columns:
        counted = F.length("__q_text").cast(documents.schema["n_chars"].dataType)
        columns["n_chars"] = F.coalesce(counted, F.col("n_chars"))
    return joined.withColumns(columns).select(*documents.columns)
