"""Connected components by alternating large and small stars.

Each step replaces a node's links by links to its least neighbour, with an aggregation (combined
before the shuffle) and a join (whose hot keys adaptive execution can split); no node's
neighbours ever meet in one task. Every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first()
    return r[0], r[1]


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of each node that has a link: root is the component's least node.

    The steps end where nothing changes any more; their number grows with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = K.stored(edges)
    state = _state(edges)
    while state[0]:
        before, edges = edges, K.stored(_small(_large(edges).where("u <> v").distinct()).where("u <> v").distinct())
        K.discard(before)
        now = _state(edges)
        if now == state:
            break
        state = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
