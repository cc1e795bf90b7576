"""Changed line ranges to changed members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import base_name, normalize_ordinals, owner_of_member, owner_of_type, path_matches, slashed
from .graph import user_types


def spans(points: DataFrame) -> DataFrame:
    """(assembly, fqn, document, first_line, last_line) of each member in each document; hidden points do not count."""
    seen = points.where("not coalesce(hidden, false) and document is not null")
    return seen.groupBy("assembly", F.col("method_fqn").alias("fqn"), "document").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


def _last_two(path: Column) -> Column:
    return F.lower(F.substring_index(slashed(path), "/", -2))


def fitting(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of documents (column document) beside rows of paths (column path) that fit them."""
    deep = F.size(F.split(F.ltrim(slashed(F.col("path")), F.lit("/")), "/")) > 2
    ends = documents.withColumn("_key", F.explode(F.array_distinct(F.array(base_name(F.col("document")), _last_two(F.col("document"))))))
    asked = paths.withColumn("_key", F.when(deep, _last_two(F.col("path"))).otherwise(base_name(F.col("path")))).where("_key <> ''")
    # a document's bare name is asked for by short paths alone
    return ends.join(asked, "_key").where(path_matches(F.col("document"), F.col("path"))).drop("_key")


def overlapping(members: DataFrame, ranges: DataFrame) -> DataFrame:
    """(assembly, fqn, document, path, start_line, end_line) of spans that changed ranges touch.

    A path that fits a document ends it at a segment's border, so both have the same last segments:
    the last two where the path has more than two (its first may be cut off), else the last one. That
    is the join's key, so common file names do not meet; path and lines are checked behind it.
    """
    hit = fitting(members, ranges)
    hit = hit.where((F.col("first_line") <= F.col("end_line")) & (F.col("last_line") >= F.col("start_line")))
    return hit.select("assembly", "fqn", "document", "path", "start_line", "end_line")


def unmatched(documents: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path) of changed paths that fit no document (column document)."""
    paths = ranges.select("path").distinct()
    hit = fitting(documents.select("document").distinct(), paths).select("path").distinct()
    return paths.join(hit, "path", "left_anti")


def owners(changed: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """Changed members with generated code given to its owner: the first method of the owner's name
    in the nearest written type, or else itself. Names are normalised; kind is always changed."""
    info = members.join(user_types(types), "type").join(types.select("type", "simple_name"), "type")
    owner = F.coalesce(owner_of_member(F.col("name")), F.when(F.col("type") != F.col("user_type"), owner_of_type(F.col("simple_name"))))
    info = info.select("assembly", "fqn", "user_type", owner.alias("owner"))
    first = members.groupBy(F.col("type").alias("user_type"), F.col("name").alias("owner")).agg(F.min_by("fqn", F.struct("token", "fqn")).alias("owner_fqn"))
    named = changed.join(info, ["assembly", "fqn"], "left").join(first, ["user_type", "owner"], "left")
    return named.select("assembly", normalize_ordinals(F.coalesce("owner_fqn", "fqn")).alias("fqn"), F.lit("changed").alias("kind")).distinct()
