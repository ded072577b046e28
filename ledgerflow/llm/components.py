"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another; component is its smallest node.

    Distributed union-find (Kiveris et al., 2014): a large-star round hangs each node's larger
    neighbours below its smallest one, a small-star round does so for the smaller neighbours. Both
    are a partially aggregated minimum, written, and one join with it straight from a shuffle, so a
    node with very many neighbours is never gathered: the skew join of adaptive execution splits it.
    Every round is written to the shared folder. Null ends and self loops are dropped; no edges give no rows.
    """
    now = stored(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where("u is not null and v is not null and u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large_star")
        lows = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lows, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        now = stored(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    children = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return children.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
