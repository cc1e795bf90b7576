"""Keyed diffs of two snapshots, and reuse by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import identity_of
from ..schemas import VERSION


def _unique(df: DataFrame, key: Column, what: str) -> DataFrame:
    """df with _key; a key that stands twice is an error when the rows are read."""
    counted = df.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"), F.first(F.struct("*")).alias("_row"))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {what}: "), F.col("_key")))).otherwise(F.col("_row"))
    return counted.select("_key", ok.alias("_row")).select("_key", "_row.*")


def diff_assemblies(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(name, status) of each assembly: added, changed, unchanged or removed.

    Names match without case and show the current casing where there is one; identities (content
    hash, else mvid) compare without case. An identity known on one side alone reads as changed.
    """
    side = lambda df, p: _unique(df, F.lower("name"), "assembly").select("_key", F.col("name").alias(f"{p}_name"), F.lower(identity_of(F.col("content_hash"), F.col("mvid"))).alias(f"{p}_id"))
    both = side(baseline, "b").join(side(current, "c"), "_key", "full_outer")
    status = F.when(F.col("b_name").isNull(), "added").when(F.col("c_name").isNull(), "removed").when(F.col("b_id").eqNullSafe(F.col("c_id")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("c_name", "b_name").alias("name"), status.alias("status"))


def diff_methods(baseline: DataFrame, current: DataFrame, assemblies: DataFrame) -> DataFrame:
    """(assembly, fqn, kind) of members in changed and added assemblies.

    kind: added, changed or removed; structural rows (...::<type>) that were added or changed are
    of kind type. Hashes and names compare by their bytes, assembly names without case.
    """
    state = assemblies.where(F.col("status").isin("added", "changed")).select(F.lower("name").alias("_a"), F.col("name").alias("_name"), "status")
    old = baseline.select(F.lower("assembly").alias("_a"), "fqn", F.col("hash").alias("old"), F.lit(True).alias("in_old"))
    new = current.select(F.lower("assembly").alias("_a"), "fqn", F.col("hash").alias("new"), F.lit(True).alias("in_new"))
    old = old.join(state.where("status = 'changed'").select("_a"), "_a", "left_semi")
    new = new.join(state.select("_a"), "_a", "left_semi")
    both = old.join(new, ["_a", "fqn"], "full_outer").join(state.select("_a", "_name"), "_a")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    kind = F.when(F.col("fqn").endswith("::<type>") & (change != "removed"), "type").otherwise(change)
    return both.where(change.isNotNull()).select(F.col("_name").alias("assembly"), "fqn", kind.alias("kind"))


def diff_content(baseline: DataFrame, current: DataFrame, version: int = VERSION) -> tuple[DataFrame, bool]:
    """(name, status) of content files that differ, and whether a warning is due.

    Names match without case, hashes by their bytes. A baseline from before content files were
    recorded is not compared; the warning is due if the current snapshot has any.
    """
    if version < 4:
        return current.select("name", F.lit("").alias("status")).where("false"), bool(current.limit(1).count())
    old = baseline.groupBy(F.lower("name").alias("_k")).agg(F.min_by("hash", "name").alias("old"), F.min("name").alias("old_name"))
    new = current.groupBy(F.lower("name").alias("_k")).agg(F.min_by("hash", "name").alias("new"), F.min("name").alias("new_name"))
    both = old.join(new, "_k", "full_outer")
    status = F.when(F.col("old_name").isNull(), "added").when(F.col("new_name").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.where(status.isNotNull()).select(F.coalesce("new_name", "old_name").alias("name"), status.alias("status")), False


def untraceable(names: DataFrame, assemblies: DataFrame) -> DataFrame:
    """Distinct names (without case) that no assembly analysed in depth has."""
    known = assemblies.where("methods_analyzed").select(F.lower("name").alias("_k"))
    one = names.groupBy(F.lower("name").alias("_k")).agg(F.min("name").alias("name"))
    return one.join(known, "_k", "left_anti").select("name")


def reuse(current: DataFrame, previous: DataFrame, previous_methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Methods carried over, and the assemblies left to hash.

    An assembly's methods carry over if it is in scope, its content hash is known and the previous
    snapshot analysed an assembly of that name (without case) and hash (by its bytes) in depth.
    """
    old = previous.where("methods_analyzed").select(F.lower("name").alias("_k"), F.col("content_hash").alias("_h"), F.col("name").alias("_old"))
    want = current.where("in_scope").select(F.col("name").alias("_name"), F.lower("name").alias("_k"), "content_hash")
    hit = want.where("content_hash <> ''").join(old, (want["_k"] == old["_k"]) & (F.col("content_hash") == F.col("_h"))).select("_name", "_old")
    carried = previous_methods.join(hit, F.col("assembly") == F.col("_old")).select(F.col("_name").alias("assembly"), "token", "fqn", "hash")
    left = current.where("in_scope").join(hit.select(F.col("_name").alias("name")), "name", "left_anti")
    return carried, left
