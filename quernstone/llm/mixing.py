"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain_text, stored, words_of

#: Hex digits of a document's hash by which a source's documents are cut up for the running sum.
BUCKET_DIGITS = 3


def fill_targets(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Targets of sources: shares of the total by weight, none above ``max_epochs`` times its size.

    ``sources`` has one row per source: ``source_size`` (long) and ``weight``.
    Each source's level is ``max_epochs * size / weight``; sources are clamped
    in the order of their levels, and what they leave is shared by weight among
    the others, until the common level lies below the next source's own. Adds
    ``target`` (double). Sources of no size get 0. The windows run over one row
    per source.
    """
    before = Window.orderBy("__level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = F.col("source_size") * F.lit(max_epochs)
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = sources.withColumn("__level", cap / F.col("weight")).withColumn("__open", left / weights)
    first = F.min(F.when(F.col("__open") <= F.col("__level"), F.struct("__level", "__open"))).over(everything)
    level = levels.withColumn("__share", first["__open"] * F.col("weight"))
    capped = cap.cast("double")
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(capped, F.coalesce("__share", capped)))
    return level.withColumn("target", target).drop("__level", "__open", "__share")


def mix_sources(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 7,
) -> DataFrame:
    """How often the mix takes each document.

    Sources in code-point order (null last) get ``weights``, repeating; the mix
    is as large as all sources together, in words. A source whose target is
    e times its size gives each document floor(e) times, and once more the
    documents that come first in a seeded order, up to the words still wanted
    (a document goes in while at least half of it fits).

    Returns ``id, source, size, source_size, target, repeats, taken``, a row per
    row given. Null texts and texts without words have size 0 and are taken
    floor(e) times, or once more, without words. Rows of one id and one text
    have one place in the order and go in together, while half of them fits;
    rows without id are placed by their text. No rows give no rows; other
    columns are not read.
    """
    sized, cuts = _cuts(documents, id_column, text_column, source_column, weights, max_epochs, seed)
    return _decided(sized, cuts).select(
        "id", "source", "size", "source_size", "target", "repeats",
        (F.col("repeats") * F.col("size")).alias("taken"),
    )


def _place(id_column: str, text_column: str, seed: int) -> Column:
    """A row's place in the seeded order: a hash of its id (of its text where it has none), then one of its text."""
    text = F.hex(F.xxhash64(plain_text(text_column)))
    name = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit(":"), text))
    return F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), name).cast("binary")), F.lit(":"), text)


def _cuts(
    documents: DataFrame, id_column: str, text_column: str, source_column: str, weights: Sequence[int], max_epochs: int,
    seed: int,
) -> tuple[DataFrame, DataFrame]:
    """The documents as stored narrow rows (id, source, size, place), and one row per source.

    The row of a source says how often it is taken whole and up to which place
    once more. Sums by hash bucket find the bucket in which the words wanted
    run out; only rows of that bucket are put in order, a 4096th of the source.
    """
    sized = stored(
        documents.select(
            F.col(id_column).alias("id"),
            F.col(source_column).cast("string").alias("source"),
            F.size(words_of(plain_text(text_column))).cast("long").alias("size"),
            _place(id_column, text_column, seed).alias("place"),
        ),
        "sizes",
    )
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")
    # The buckets' sums are all that the sources' sizes are made of, so documents are summed once.
    buckets = stored(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "buckets")
    sources = buckets.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("weight", weight)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = fill_targets(sources, max_epochs).withColumn("whole", whole)
    targets = targets.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = stored(targets.select("source", "source_size", "target", "whole", "wanted"), "targets")

    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("words").over(order), F.lit(0)))
    # Buckets that end before the words run out go in whole, those that start behind do not.
    reached = _by_source(starts, targets.where("wanted > 0")).where("start <= wanted")
    last = reached.groupBy("source").agg(
        F.max(F.struct("bucket", "start")).alias("last"), F.first("wanted").alias("wanted")
    )
    last = last.select("source", "last.bucket", "last.start", "wanted")
    inside = _by_source(sized.select("source", "place", "size"), last).where(bucket == F.col("bucket"))
    places = inside.groupBy("source", "place").agg(
        F.sum("size").alias("size"), F.first("start").alias("start"), F.first("wanted").alias("wanted")
    )
    before = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = F.col("start") + F.coalesce(F.sum("size").over(before), F.lit(0))
    fits = places.select("source", "place", (2 * running + F.col("size") <= 2 * F.col("wanted")).alias("fits"))
    ends = fits.groupBy("source").agg(F.max(F.when(F.col("fits"), F.col("place"))).alias("end"))
    # Without a place in its last bucket a source ends before the bucket.
    ends = _by_source(last.select("source", "bucket"), ends).select("source", F.coalesce("end", "bucket").alias("end"))
    cuts = targets.alias("t").join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
    return sized, stored(cuts.select("t.source", "source_size", "target", "whole", "end"), "cuts")


def _by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the columns of their source. Null sources are a source of their own."""
    named = sources.withColumnRenamed("source", "__source")
    return rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _decided(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add how often rows (source, place) are taken; where the cuts are few, no row moves for it."""
    once_more = F.when(F.col("place") <= F.col("end"), 1).otherwise(0)
    return _by_source(rows, cuts).withColumn("repeats", (F.col("whole") + once_more).cast("long"))


def mixed_documents(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 7,
) -> DataFrame:
    """The rows of the mix, with all their columns: each row as often as ``mix_sources`` takes it.

    A row's place follows from the row alone, so that texts are read where they
    lie once the cuts are known. See ``mix_sources`` for null and repeated rows.
    """
    _, cuts = _cuts(documents, id_column, text_column, source_column, weights, max_epochs, seed)
    rows = documents.select(
        F.struct(*(documents[c] for c in documents.columns)).alias("__mix_row"),
        F.col(source_column).cast("string").alias("source"),
        _place(id_column, text_column, seed).alias("place"),
    )
    copies = _decided(rows, cuts).where("repeats > 0").select(
        "__mix_row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))
    )
    return copies.select(*(F.col(f"__mix_row.`{c}`").alias(c) for c in documents.columns))
