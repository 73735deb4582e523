"""Links between the members of buckets, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

POSTING = ("token", "id", "size", "place", "need")
#: Longs of a set's bitmap.
BITMAP = 8
#: After so many rounds of leaders, the pairs that are left are tried all.
ROUNDS = 4


def linked(
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    least_percent: int,
    rounds: int = ROUNDS,
    known: DataFrame | None = None,
) -> DataFrame:
    """``id, component`` of the ids that a verified link, or one of the links ``known`` (``a, b``), joins to another.

    ``postings`` (``token, id, size, place, need, bits``; stored) puts ids into buckets
    by token. ``size`` is that of a set of tokens in one order for all, and
    ``place`` the token's in it; 0 where buckets are of another kind. Linked
    sets have a Jaccard similarity of at least ``least_percent`` of a hundred,
    so that sets of sizes m and n share at least o = (m + n) * p / (1 + p)
    tokens, and of their first m - o + l and n - o + l at least l, for l the
    smaller ``need``. ``bits`` is a bitmap of the set (``BITMAP`` longs, or none),
    each token turning one bit over: the bits in which two differ are no more
    than the tokens that one of them lacks, m + n - 2 o at most. ``verify``
    takes pairs ``a, b`` and returns those that are links.

    A pair of which links are known to join both says nothing new. So each
    bucket first tries its members against one leader, a different one each
    round, which joins groups of copies in as many pairs as they have members.
    Labels follow the links: ids of one label are joined. When a round leaves
    fewer pairs of different labels than postings, or more than a quarter of
    those before it, all that are left and meet the bounds above are tried, so
    no component is missed.
    """
    spark = postings.sparkSession
    labelled = postings.select(*POSTING).withColumn("label", F.col("id"))
    kind = postings.schema["id"].dataType.simpleString()
    links = spark.createDataFrame([], f"a {kind}, b {kind}") if known is None else known
    labels = before = None
    for turn in range(rounds):
        buckets = stored(_buckets(labelled, turn), "buckets")
        left = buckets.agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
        if before is not None and ((left["pairs"] or 0) <= (left["n"] or 0) or 4 * left["pairs"] > before):
            break
        before = left["pairs"] or 0
        pairs = labelled.join(buckets, "token").where(
            (F.col("label") != F.col("lead_label")) & _alike("size", "lead_size", least_percent)
        )
        pairs = pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
        found = stored(verify(stored(pairs, "pairs")), "found")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        labels = stored(_followed(links, labels), "labels")
        labelled = stored(_relabelled(postings, labels), "labelled")
    buckets = stored(_buckets(labelled, 0).select("token"), "buckets")
    live = labelled.join(buckets, "token", "left_semi")
    # Bitmaps are carried by what is paired alone, not from round to round.
    live = stored(live.join(postings.groupBy("id").agg(F.first("bits").alias("bits")), "id"), "live")
    one, two = (live.select(*(F.col(c).alias(f"{c}_{k}") for c in live.columns)) for k in "ab")
    pairs = one.join(two, F.col("token_a") == F.col("token_b")).where(
        (F.col("id_a") < F.col("id_b"))
        & (F.col("label_a") != F.col("label_b"))
        & _alike("size_a", "size_b", least_percent)
        & _early("a", least_percent)
        & _early("b", least_percent)
        & _near(least_percent)
    )
    shared = pairs.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.least(F.min("need_a"), F.min("need_b")).alias("need")
    )
    rest = stored(shared.where("shared >= need").select("a", "b"), "pairs")
    return components(links.unionByName(stored(verify(rest), "found")))


def _alike(one: str, two: str, least_percent: int):
    return F.least(one, two) * 100 >= F.greatest(one, two) * least_percent


def _overlap(least_percent: int):
    """How many tokens sets of these sizes must share: the least whole number that will do."""
    both = F.col("size_a") + F.col("size_b")
    return F.floor((both * least_percent + (99 + least_percent)) / (100 + least_percent))


def _early(side: str, least_percent: int):
    """Whether the token stands in the prefix that this pair's sizes leave to the set of one side."""
    room = F.col(f"size_{side}") - _overlap(least_percent)
    return F.col(f"place_{side}") < room + F.least("need_a", "need_b")


def _near(least_percent: int):
    """Whether the bitmaps differ in no more bits than linked sets do in tokens."""
    differ = [
        F.coalesce(F.bit_count(F.get("bits_a", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))), F.lit(0))
        for k in range(BITMAP)
    ]
    return sum(differ[1:], differ[0]) <= F.col("size_a") + F.col("size_b") - 2 * _overlap(least_percent)


def _buckets(labelled: DataFrame, turn: int) -> DataFrame:
    """``token, n, pairs, lead, lead_label, lead_size`` of buckets with several labels.

    ``pairs`` counts those of different labels. The leader is the smallest id, in later rounds that of the least hash.
    """
    order = F.xxhash64(F.lit(turn), "id") if turn else F.col("id")
    lead = F.struct(
        order.alias("order"), F.col("id").alias("lead"), F.col("label").alias("lead_label"), F.col("size").alias("lead_size")
    )
    parts = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), F.min(lead).alias("lead"))
    whole = parts.groupBy("token").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("square"), F.min("lead").alias("lead")
    )
    pairs = ((F.col("n") * F.col("n") - F.col("square")) / 2).cast("long")
    return whole.select("token", "n", pairs.alias("pairs"), "lead.lead", "lead.lead_label", "lead.lead_size").where("pairs > 0")


def _followed(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``id, label``: each linked id's least label among its own and its neighbours'."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if labels is None:
        known = both.select(F.col("a").alias("id"), F.col("b").alias("label"))
    else:
        reached = labels.select(F.col("id").alias("b"), F.col("label").alias("b_label"))
        known = both.join(reached, "b", "left").select(F.col("a").alias("id"), F.coalesce("b_label", "b").alias("label"))
        known = known.unionByName(labels)
    least = known.groupBy("id").agg(F.min("label").alias("label"))
    return least.select("id", F.least("id", "label").alias("label"))


def _relabelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    return postings.select(*POSTING).join(labels, "id", "left").select(*POSTING, F.coalesce("label", "id").alias("label"))
