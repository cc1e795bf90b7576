"""Graph cache: Parquet folders named by content keys, shared by runs."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import short_hash

#: Part of every key: raise it when what is cached changes its meaning.
FORMAT = 1
KEEP_DAYS = 7


def _lines(name: Column, mvid: Column) -> Column:
    line = F.concat(F.lower(name), F.lit(":"), mvid)
    return F.array_join(F.sort_array(F.collect_list(line)), "\n")


def whole_key(assemblies: DataFrame, scope: str, framework: str) -> DataFrame:
    """(key) of a whole build: format, scope, framework and each assembly in depth with its mvid."""
    head = f"{FORMAT}\n{scope}\n{framework.lower()}\n"
    return assemblies.where("methods_analyzed").agg(short_hash(F.concat(F.lit(head), F.coalesce(_lines(F.col("name"), F.col("mvid")), F.lit("")))).alias("key"))


def part_keys(assemblies: DataFrame, closure: DataFrame, scope: str, framework: str) -> DataFrame:
    """(name, key) of each assembly: itself and all it refers to (closure: name, ref), with their mvids."""
    head = f"{FORMAT}\n{scope}\n{framework.lower()}\n"
    own = assemblies.select(F.lower("name").alias("name"), F.lower("name").alias("ref"))
    every = own.unionByName(closure.select(F.lower("name").alias("name"), F.lower("ref").alias("ref"))).distinct()
    ids = assemblies.select(F.lower("name").alias("ref"), "mvid")
    return every.join(ids, "ref").groupBy("name").agg(short_hash(F.concat(F.lit(head), F.col("name"), F.lit("\n"), _lines(F.col("ref"), F.col("mvid")))).alias("key"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def load(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """What is cached under a key; None if nothing is, or it cannot be read."""
    try:
        fs, p = _fs(spark, f"{root}/{key}/_SUCCESS")
        return spark.read.parquet(f"{root}/{key}") if fs.exists(p) else None
    except PySparkException:
        return None


def save(df: DataFrame, root: str, key: str) -> None:
    """Writes beside and renames, so that no reader sees half of it; a run that comes second changes nothing."""
    spark = df.sparkSession
    temporary = f"{root}/.{key}-{uuid.uuid4().hex}"
    df.write.parquet(temporary)
    fs, new = _fs(spark, temporary)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{key}")
    if fs.exists(target) or not fs.rename(new, target):
        fs.delete(new, True)


def prune(spark: SparkSession, root: str, days: float = KEEP_DAYS) -> int:
    """Drops what was not written for so many days; returns how much."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return 0
    limit = spark.sparkContext._jvm.java.lang.System.currentTimeMillis() - int(days * 86_400_000)
    old = [s.getPath() for s in fs.listStatus(p) if s.getModificationTime() < limit]
    return sum(bool(fs.delete(x, True)) for x in old)


def stable_key(*parts: str) -> str:
    """The driver's own key of a few strings."""
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32].upper()
