"""Connected components of a table of links by alternating large and small
stars: every round is a few grouped minima and joins, with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloom.llm.common import checkpoint


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """From (u, v) to (u, m), m the least node reachable from u, for every node
    but the least of its component. No link gives no row."""
    edges = checkpoint(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both).select("u", F.least("u", "m").alias("m")), "u")
            .where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = _least(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("u", F.col("v").alias("m"))
        before = now
