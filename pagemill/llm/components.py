"""Connected components of an edge table, by alternating stars, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u long, v long) in any direction, loops and repeats allowed -> (node, component), where
    component is the smallest node reachable. Nodes without an edge to another don't appear.

    Each round is a large star and a small star (Kiveris et al., 2014): O(log^2 n) rounds at most, each a few
    shuffles of at most as many rows as there are edges. Minima are combined before the shuffle, and hubs
    meet their edges in joins that adaptive execution may split.
    """
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = checkpointed(small.where("u <> v").distinct())
        if (new := _state(now)) == state:
            break
        state = new
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    top = now.groupBy("u").agg(F.min("v").alias("component"))
    return top.select(F.col("u").alias("node"), "component").unionByName(top.select(F.col("component").alias("node"), "component").distinct())
