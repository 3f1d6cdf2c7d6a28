"""Connected components by alternating stars.

Each round points every node's larger neighbours at its smallest one, then
every node's smaller neighbours. Edges never grow in number, and the graph
becomes a set of stars in a few rounds. Rounds are staged in the shared folder,
so lineage stays short and a lost executor costs one round at most. Only a
count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and its ``component``, the smallest node it is connected with.

    ``edges`` has columns ``a`` and ``b`` of any ordered type; loops, repeated
    edges and either direction are fine. Nodes without edges are absent.
    """
    stars = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(),
        "stars",
    )
    before = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before, stars = now, stage(_small_stars(_large_stars(stars)), "stars")


def _large_stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
