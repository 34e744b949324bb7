"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): each linked node with the least node it can reach.

    Rounds of large-star and small-star: every node hands its least neighbour on,
    until the links are stars. A node's neighbours are never gathered; its least
    neighbour is joined back to its links, so a hub is only a skewed join key.
    """
    edges = cut_lineage(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct(),
        "links",
    )
    last = None
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = (
            both.join(least, "v")
            .where("u > v")
            .select(F.col("u").alias("v"), F.col("m").alias("u"))
            .distinct()
        )
        # ``large`` has every link once, from the greater node.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v")
            .where("u <> m")
            .select(F.col("u").alias("v"), F.col("m").alias("u"))
            .union(least.select("v", F.col("m").alias("u")))
            .distinct()
        )
        edges = cut_lineage(small, "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        last = state
