"""Connected components of pairs, as jobs over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(pairs: DataFrame) -> DataFrame:
    """``id, component`` of every id in the pairs ``a, b``: the smallest id it is linked with.

    Alternates two steps (Kiveris et al., 2014) until every id points at a
    root: each id's larger neighbours are linked with its smallest one, then its
    smaller neighbours. Each round reads and writes pairs in the shared folder;
    the number of rounds grows with the logarithm of a component's size. A hub
    is one side of a join, never gathered.
    """
    links = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = stored(links.distinct(), "links")
    while not _is_done(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = stored(large, "links")
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        links = stored(small.unionByName(lowest.select("u", F.col("low").alias("v"))).distinct(), "links")
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _is_done(links: DataFrame) -> bool:
    """Whether every id points at one other that points at none."""
    several = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    chained = links.join(links.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return several.unionByName(chained).isEmpty()
