"""Connected components of an edge table by alternating large-star and small-star steps, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v). The least neighbour of each node is written before it
    is joined, so the join exchanges both sides and adaptive execution can split the edges of a hub."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(cut(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = cut(large.distinct())
    least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    small = small.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return fresh(cut(small.where("u <> v").distinct()))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Self-links, repeated and reversed edges are allowed, edges with a null end are ignored, no edges give no rows.
    Rounds grow with the logarithm of the longest chain; each ends in the shared folder. Only two numbers a round come
    to the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v")
    e = fresh(cut(e.distinct()))
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = mark(e)
    while state[0]:
        e = _stars(e)
        if (now := mark(e)) == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
