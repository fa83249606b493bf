"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane.llm.common import saved


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node reachable, for every node that a link (a, b) of longs names.

    Each round writes its edges to the shared folder; the number of rounds grows with the logarithm of a component's
    size. No component is gathered anywhere.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _print(edges)
    while True:
        # Large star: neighbours above a node go to the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: a node and its neighbours below go to the smallest of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        edges = saved(small, "edges")
        after = _print(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        before = after
