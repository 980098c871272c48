"""Connected components of a graph given as links, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: columns ``a``, ``b``. Returns ``node``, ``root``, the smallest node reachable, for every node that has a link.

    Alternates large-star and small-star steps until a round changes nothing; the number of rounds grows with
    the logarithm of a component's size. Only minima are formed per node, so a node with many links is
    pre-aggregated before its shuffle, and each round is written to the shared folder.
    """
    pairs = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        pairs = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            return pairs.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
