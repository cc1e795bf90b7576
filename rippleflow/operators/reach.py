"""Reachability over dependency edges, level by level.

An edge (callee, caller) points where impact flows. Each level joins the frontier with the
edges, drops what was reached before and keeps the least chain of each new node; levels are
written to the shared folder, so neither plan nor lineage grows with depth, and a lost executor
costs one level at most. Only the frontier carries chains: what was reached before is read for its
node column alone. Small frontiers are broadcast by their measured size, so the edges stay where
they are; hot nodes are left to adaptive skew joins, and the aggregation by caller combines before
it shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import shared_dir, stored


def _written(df: DataFrame, path: str) -> int:
    """Writes a level and returns its rows, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def _deepest(df: DataFrame, path: str) -> int:
    """Writes pairs and returns their greatest depth, 0 if there are none."""
    seen = Observation()
    df.observe(seen, F.max("depth").alias("far")).write.parquet(path)
    return seen.get["far"] or 0


def reach(edges: DataFrame, seeds: DataFrame, chains: bool = True, most: int | None = None, written: bool = False) -> DataFrame:
    """(node, depth, chain) of every node reached from seeds (column node), the seeds included.

    depth is the least number of edges; chain the least of the shortest chains, seed first. Cycles
    end where they meet a node reached before. Without chains, chain is not built. most bounds depth.
    written: the edges are a table that can be read at every level; else they are written once.
    """
    spark = edges.sparkSession
    edges = edges.select("callee", "caller").where("callee <> caller")
    edges = edges if written else stored(edges)
    first = seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0))
    if chains:
        first = first.withColumn("chain", F.array("node"))
    schema, paths, depth = first.schema, [shared_dir(spark)], 0
    _written(first, paths[0])
    while most is None or depth < most:
        frontier = spark.read.schema(schema).parquet(paths[-1])
        visited = spark.read.schema(schema).parquet(*paths).select(F.col("node").alias("caller"))
        step = edges.join(frontier, F.col("callee") == F.col("node"))
        out = step.groupBy("caller").agg(F.min("chain").alias("chain")) if chains else step.select("caller").distinct()
        out = out.join(visited, "caller", "left_anti")
        depth += 1
        cols = [F.col("caller").alias("node"), F.lit(depth).alias("depth")]
        if chains:
            cols.append(F.concat("chain", F.array("caller")).alias("chain"))
        paths.append(shared_dir(spark))
        if not _written(out.select(*cols), paths[-1]):
            break
    return spark.read.schema(schema).parquet(*paths)


def closure(pairs: DataFrame, most: int, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, depth) of the transitive closure of pairs of strings up to most steps, with the least
    depth; no name reaches itself.

    Doubling: the pairs of up to span steps are known. A shortest path of up to twice as many has a
    node just span steps from its start, so a round joins the pairs of exactly span steps with all
    known ones: in a tree it makes every pair once, and nodes near the root, which all others reach,
    are met from the few at that distance. Each round writes what is new, and nothing is written twice.
    """
    spark = pairs.sparkSession
    first = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct().withColumn("depth", F.lit(1))
    schema, paths, span = first.schema, [shared_dir(spark)], 1
    far = _deepest(first, paths[0])
    while far == span < most:
        known = spark.read.schema(schema).parquet(*paths)
        ends = spark.read.schema(schema).parquet(paths[-1]).where(F.col("depth") == span).select(F.col("a").alias("from"), F.col("b").alias("via"))
        longer = ends.join(known, F.col("via") == F.col("a")).select(F.col("from").alias("a"), "b", (F.col("depth") + span).alias("depth"))
        longer = longer.where((F.col("depth") <= most) & (F.col("a") != F.col("b")))
        new = longer.groupBy("a", "b").agg(F.min("depth").alias("depth")).join(known.select("a", "b"), ["a", "b"], "left_anti")
        paths.append(shared_dir(spark))
        far, span = _deepest(new, paths[-1]), span * 2
    return spark.read.schema(schema).parquet(*paths).withColumnsRenamed({"a": a, "b": b})


def closure_to(pairs: DataFrame, ends: DataFrame, most: int, a: str = "a", b: str = "b") -> DataFrame:
    """The rows of closure() that lead to ends (column b), without the rest of it.

    Level by level from the ends: a level costs the pairs and what was found so far, and no row is
    made that does not lead to an end.
    """
    spark = pairs.sparkSession
    own = stored(pairs.select(F.col(a).alias("from"), F.col(b).alias("via")).where(F.col("from") != F.col("via")))
    first = ends.select(F.col(b).alias("via")).distinct().join(own, "via").select(F.col("from").alias("a"), F.col("via").alias("b")).distinct().withColumn("depth", F.lit(1))
    schema, paths, depth = first.schema, [shared_dir(spark)], 1
    found = _written(first, paths[0])
    while found and depth < most:
        depth += 1
        known, level = spark.read.schema(schema).parquet(*paths), spark.read.schema(schema).parquet(paths[-1])
        step = own.join(level, F.col("via") == F.col("a")).select(F.col("from").alias("a"), "b").where("a <> b").distinct()
        paths.append(shared_dir(spark))
        found = _written(step.join(known.select("a", "b"), ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)), paths[-1])
    return spark.read.schema(schema).parquet(*paths).withColumnsRenamed({"a": a, "b": b})


def reference_closure(references: DataFrame) -> DataFrame:
    """(name, ref) of all direct and indirect references, without case."""
    low = references.select(F.lower("name").alias("name"), F.lower("ref").alias("ref"))
    return closure(low, 1 << 20, "name", "ref").select("name", "ref")
