"""Connected components on the cluster, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import materialise

#: Far above the logarithm of any node count; reaching it means a fault, not a large input.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of ``edges`` and the smallest node that it reaches.

    Null ends and loops are dropped; no edge gives no row. Each round's edges are written to the shared
    folder, so a lost executor costs one round. A hub's minimum is a grouped aggregate, and the join
    that hands it to the hub's edges is one that AQE can split.
    """
    ends = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = materialise(ends.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        now = materialise(small.unionByName(roots.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
