"""Connected components of links between numbered things, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaglint.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for links ``a``, ``b`` (long); roots themselves have no row.

    Each round hangs all neighbours of a node on their smallest one, first the larger neighbours and then
    the smaller ones, so rounds grow with the logarithm of the links at most squared. Minima are combined
    before the shuffle, and joins bring one row to each neighbour, so a node of many links is no group that
    a task must hold. Each round is cut by a reliable checkpoint; links never reach the driver.
    """
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(hung.unionAll(lowest.select("a", F.col("m").alias("b"))).distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
