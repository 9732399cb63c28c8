"""Connected components of a table of links, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MOST_ROUNDS = 60
BROADCAST_ROWS = 500_000
FEW_ROWS = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """node, comp: for every node of `edges` (a, b long) the smallest node that it reaches.

    Large-star and small-star contraction: each round links the larger neighbours of a node, or the
    node and its smaller neighbours, to the smallest one, until the links are stars. A hub's
    neighbours are never gathered: each needs the minimum alone, which is a partial sum. Rounds grow with the
    logarithm of the longest path, and end when every node is a centre or has one. Each round is written, so
    lineage stays short; minima are broadcast where the counted links are few.
    """
    links = saved(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    for _ in range(MOST_ROUNDS):
        n = links.count()
        small = F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
        links = links.coalesce(1) if n <= FEW_ROWS else links  # small tables are not dealt out again and again
        ends = links.select(F.col("lo").alias("u"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(links.select("hi", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).where("high > 1 or high > 0 and low > 0").isEmpty():
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(links.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(small(least), "u").where("v > u and v <> m").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        turned = large.join(small(down), "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo <> hi")
        links = saved(turned.union(down.select(F.col("m").alias("lo"), "hi")).distinct(), "links")
    raise RuntimeError("components did not settle")
