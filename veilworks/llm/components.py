"""Connected components by alternating stars, each step a distributed join of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.llm.engine import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) reaches, itself included.

    Large and small stars in turn until nothing changes; each step is written to the shared folder.
    The number of links never grows, and no node gathers its links in one row.
    """
    edges = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        edges = settle(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            leaves = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
            return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
        last = now
