"""Connected components of links between ids, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.shared import saved


def components(links: DataFrame) -> DataFrame:
    """Component of each id that has a link.

    ``links`` has ``a`` and ``b``; direction, repeats and loops don't matter. Returns ``id`` and ``component``,
    the smallest id reachable. Every link is drawn to the smaller end, then each round links all neighbours of
    an id to its smallest one and shortens paths; the links that are left when nothing changes form stars.
    Rounds grow with the logarithm of the longest path, each is written, and no round meets a whole component
    in one task: a hub's neighbours are joined as rows.
    """
    edges = saved(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("to"))
        .distinct()
    )
    before = None
    while True:
        # Large star: neighbours above an id join its smallest neighbour (or itself).
        both = edges.select("id", "to").union(edges.select(F.col("to").alias("id"), F.col("id").alias("to")))
        low = both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("low"))
        large = (
            both.where(F.col("to") > F.col("id"))
            .join(low, "id")
            .select(F.col("to").alias("id"), F.col("low").alias("to"))
            .distinct()
        )
        # Small star: lower neighbours of an id, and itself, join the smallest of them.
        least = large.groupBy("id").agg(F.min("to").alias("low"))
        small = (
            large.join(least, "id")
            .select(F.explode(F.array("id", "to")).alias("id"), F.col("low").alias("to"))
            .where(F.col("id") != F.col("to"))
            .distinct()
        )
        edges = saved(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("id", "to").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("id").agg(F.min("to").alias("component")).select(F.col("id"), F.col("component")).union(
        edges.select(F.col("to").alias("id"), F.col("to").alias("component")).distinct()
    )
