"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """``u, v`` -> ``u, v, m``: the smallest of u and its neighbours beside every edge.

    The minimum is aggregated before the shuffle and joined back, so a node with very many
    edges is a skewed join side that adaptive execution splits, not one group in one task.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("_m", "u").alias("m"))
    return edges.join(low, F.col("u") == F.col("_u")).drop("_u")


def components(edges: DataFrame, keep: Scratch, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``id, component`` for every node with an edge, ``component`` the least id reachable."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = keep.save(now, "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        near = _least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        then = keep.save(small, "edges")
        seen = then.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        keep.drop(now)
        now = then
        if mark == (seen["n"], seen["x"]):
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        mark = (seen["n"], seen["x"])
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
