"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpanel.functions.session import written_table


def stars(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node but the roots.

    ``edges`` has (a, b), in any direction, repeats and loops allowed. Alternates
    large-star and small-star steps: every neighbour larger than a node is linked
    to the smallest node known there, until the edges are stars. Each step is a
    minimum per node, combined before the shuffle, and is written to the shared
    folder, so lineage stays short; the driver sees one number per step.
    """
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo")
    while True:
        # large-star: per node, all larger neighbours go to the smallest of the neighbourhood
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small-star: per node, its smaller neighbours and itself go to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = (
            joined.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(least.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        pairs = written_table(small, "stars")
        # stars: every node is linked to one smaller node at most, and roots to none
        ends = pairs.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            pairs.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if degrees.filter("up + down > 1").count() == 0:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge to
    another; see ``stars``."""
    below = stars(edges)
    return below.unionByName(below.select(F.col("root").alias("node"), "root").distinct())
