"""Connected components of a table of links, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convq.llm.tables import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    near = _both_ways(links)
    low = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return near.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; a > b in ``links``."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.withColumnRenamed("low", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node in ``links`` (``a, b``, any order, repeats allowed).

    The component is its smallest node.  Large and small stars in turn; rounds grow with the
    logarithm of the longest chain.  Each round is written to the shared folder, so no plan
    grows, and only a count and a checksum come to the driver.
    """
    links = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
    before = None
    while True:
        now = links.agg(*state).first()
        if now == before or now[0] == 0:
            break
        before = now
        links = stored(_small_star(_large_star(links)), "links")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
