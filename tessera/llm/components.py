"""Connected components of a graph that no machine could hold: alternating star contraction.

A large star hangs every larger neighbour on the smallest of the neighbourhood, a small star every smaller one; edges only shorten, and in
O(log² n) rounds each component is one star around its smallest node. A round is group-bys and equi-joins; its edges are written to the shared
folder, so that plans stay short and a lost executor costs no earlier round. Only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long; direction, order and repeats don't matter; null ends are ignored). Returns node, component for every node that has an edge to
    another one; component is the smallest node reachable."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = written(small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        if (now := _state(e)) == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
