"""Connected components by alternating large-star and small-star steps over an edge table.

Each step points a node's larger neighbours, then its smaller ones, at the least neighbour; a number of rounds in
the order of the logarithm of the longest path reaches stars. Every round writes its edges to the shared folder, so
lineage stays short. Hubs are met by partial aggregation (a minimum per node) and by joins that adaptive execution
may split; no neighbourhood is gathered into a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.sources.shared import Stored

MAX_ROUNDS = 100


def _digest(edges: DataFrame) -> tuple:
    """Count and two sums of 64-bit hashes of distinct edges: one scan without a shuffle of edges tells whether a round changed them."""
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), wide(F.xxhash64("u", "v")), wide(F.xxhash64(F.lit(1), "v", "u"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, component (the least node reachable) for every node with an edge. Self-loops and repeats are harmless; nulls are dropped."""
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    stars = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    held = Stored(stars.distinct(), "components")
    nodes = Stored(held.df.select(F.col("u").alias("node")).union(held.df.select("v")).distinct(), "component-nodes")
    held_edges = Stored(held.df.where("u > v"), "components")
    held.drop()
    now = _digest(held_edges.df)
    for _ in range(max_rounds):
        both = held_edges.df.union(held_edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = Stored(large.where("u > v").distinct(), "components-large")
        low = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = Stored(small.where("u > v").distinct(), "components")
        held_edges.drop()
        large.drop()
        held_edges, before, now = after, now, _digest(after.df)
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    low = held_edges.df.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.df.join(low, F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))
