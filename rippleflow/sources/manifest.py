"""Snapshots as relations in a folder, and as JSON manifests.

A folder of relations is read and written in parallel, however large a build is; a JSON manifest
is one nested row, which suits what other tools exchange.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def load(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as one nested row; an unreadable or empty document is an error when it is read."""
    df = spark.read.schema(schemas.MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.withColumn("version", F.when(F.col("version").isNull() & F.col("assemblies").isNull(), F.raise_error(F.lit("empty manifest")).cast("int")).otherwise(F.coalesce("version", F.lit(1))))


def relations(manifest: DataFrame) -> dict[str, DataFrame]:
    """snapshot, assembly, method and content_file of a nested manifest."""
    entry = manifest.select(F.explode("assemblies").alias("a"))
    blank = F.lit("")
    return {
        "snapshot": manifest.select("version", F.coalesce("tfm", blank).alias("tfm"), F.coalesce("scope", blank).alias("scope")),
        "assembly": entry.select("a.name", F.coalesce("a.mvid", blank).alias("mvid"), F.coalesce("a.contentHash", blank).alias("content_hash"), F.coalesce("a.methodsAnalyzed", F.lit(False)).alias("methods_analyzed")),
        "method": entry.select(F.col("a.name").alias("assembly"), F.explode("a.methods").alias("m")).select("assembly", "m.token", "m.fqn", "m.hash"),
        "content_file": manifest.select(F.explode("contentFiles").alias("c")).select("c.name", "c.hash"),
    }


def nested(spark: SparkSession, tfm: str, scope: str, assembly: DataFrame, method: DataFrame, content_file: DataFrame) -> DataFrame:
    """The nested row of a snapshot: assemblies, methods and files in name order."""
    entry = F.struct("token", "fqn", "hash")
    methods = method.groupBy("assembly").agg(F.transform(F.sort_array(F.collect_list(F.struct("fqn", entry.alias("m")))), lambda x: x["m"]).alias("methods"))
    rows = assembly.join(methods, assembly["name"] == methods["assembly"], "left")
    one = F.struct("name", "mvid", F.col("content_hash").alias("contentHash"), F.col("methods_analyzed").alias("methodsAnalyzed"), F.coalesce("methods", F.array().cast("array<struct<token:int,fqn:string,hash:string>>")).alias("methods"))
    a = rows.agg(F.sort_array(F.collect_list(one)).alias("assemblies"))
    c = content_file.agg(F.sort_array(F.collect_list(F.struct("name", "hash"))).alias("contentFiles"))
    head = spark.range(1).select(F.lit(schemas.VERSION).alias("version"), F.lit(tfm).alias("tfm"), F.lit(scope).alias("scope"))
    return head.crossJoin(a).crossJoin(c)  # one row each


def save_relations(spark: SparkSession, tfm: str, scope: str, assembly: DataFrame, method: DataFrame, content_file: DataFrame, path: str) -> None:
    """The relations as Parquet below a folder; the header comes last, so half a snapshot cannot be read."""
    for name, df in (("assembly", assembly), ("method", method), ("content_file", content_file)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    head = spark.createDataFrame([(schemas.VERSION, tfm, scope)], "version int, tfm string, scope string")
    head.coalesce(1).write.mode("overwrite").parquet(f"{path}/snapshot")


def load_relations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations of a folder, or of a JSON manifest."""
    try:
        head = spark.read.parquet(f"{path}/snapshot")
    except AnalysisException:
        return relations(load(spark, path))
    return {"snapshot": head, **{name: spark.read.parquet(f"{path}/{name}") for name in ("assembly", "method", "content_file")}}


def save(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)
