"""Connected components of a link table by alternating stars; every round is a few joins over links, never a graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import materialise


def _least(links: DataFrame, label: str) -> DataFrame:
    """The smallest neighbour of each ``a``. Written, so that a hub's links can be dealt to many tasks in the join that follows."""
    return materialise(links.groupBy("a").agg(F.min("b").alias("m")), label)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of a link between different nodes; the component is its smallest node.

    Links with a null end and links of a node with itself say nothing. Repeated links count once.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges, before = materialise(edges, "links"), None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = _least(both, "large-star").withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        least = _least(large, "small-star")
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = materialise(small.distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
