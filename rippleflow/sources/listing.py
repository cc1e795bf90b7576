"""File listings: which copy of a file counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import in_scope, slashed
from ..schemas import METHOD


def scan(spark: SparkSession, directories: list[str], pattern: str) -> DataFrame:
    """(path, file, dir_index, modified, content) of files below the directories; content is read only if asked for."""
    if not directories:
        raise ValueError("no directory given")

    def one(i: int, d: str) -> DataFrame:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(d)
        return df.select("path", F.substring_index("path", "/", -1).alias("file"), F.lit(i).alias("dir_index"), F.col("modificationTime").alias("modified"), "content")

    return reduce(DataFrame.unionByName, [one(i, d) for i, d in enumerate(directories)])


def _first(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest(files: DataFrame) -> DataFrame:
    """Of each file name (without case) the newest copy; ties go by directory, then path."""
    return _first(files, F.lower("file"), F.col("modified").desc(), F.col("dir_index"), F.col("path"))


def first(files: DataFrame) -> DataFrame:
    """Of each file name (without case) the first copy, by directory and path."""
    return _first(files, F.lower("file"), F.col("dir_index"), F.col("path"))


def first_assembly(scanned: DataFrame) -> DataFrame:
    """Of each assembly name (without case) the one of the least path."""
    return _first(scanned, F.lower("name"), F.col("path"))


def content_files(files: DataFrame) -> DataFrame:
    """(name, hash) of content files; one that cannot be read gets a hash of its own, so it reads as changed."""
    one = first(files.where(F.lower("file").rlike(r"\.(json|config)$")))
    return one.select(F.col("file").alias("name"), F.coalesce(F.upper(F.sha2("content", 256)), F.expr("uuid()")).alias("hash"))


def with_symbols(files: DataFrame) -> DataFrame:
    """Adds has_symbols: whether a .pdb of the same stem stands beside the file."""
    stem = F.regexp_replace(slashed(F.col("path")), r"\.[^./]*$", "")
    pdb = files.where(F.lower("file").endswith(".pdb")).select(F.lower(stem).alias("_stem")).distinct().withColumn("has_symbols", F.lit(True))
    return files.withColumn("_stem", F.lower(stem)).join(pdb, "_stem", "left").withColumn("has_symbols", F.coalesce("has_symbols", F.lit(False))).drop("_stem")


def scoped(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Adds in_scope by the file's stem."""
    return files.withColumn("in_scope", in_scope(F.regexp_replace("file", r"\.[^.]*$", ""), F.col("has_symbols"), include, exclude))


def no_methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], METHOD)
