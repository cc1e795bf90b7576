"""Tests that a set of changes selects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import key_of_fqn, pretty_key, type_key, wildcard_regex
from ..schemas import SCOPE_ASSEMBLY, SCOPE_FIXTURE, SCOPE_GLOBAL
from .graph import BASE_DEPTH
from .reach import closure, closure_to

#: Seed-phase selections come before those of the walk.
PHASE_SEED, PHASE_WALK = 0, 1


def seeds(changes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, type) seeds of changes: each change's key; for a changed type, and for the type of a
    removed member, the type's node and all its members too. type is null for a plain member."""
    keyed = changes.select(key_of_fqn(F.col("fqn")).alias("node"), "kind").where("node is not null")
    plain = keyed.select("node", F.lit(None).cast("string").alias("type")).where("not startswith(node, 'TN:')")
    types = keyed.select(
        F.when(F.col("node").startswith("TN:"), F.substring("node", 4, 1 << 20)).when(F.col("kind") == "removed", F.substring_index("node", "::", 1)).alias("type")
    ).where("type is not null").distinct()
    nodes = types.select(type_key(F.col("type")).alias("node"), "type")
    inner = types.join(members, "type").select(F.col("member_key").alias("node"), "type")
    return plain.unionByName(nodes).unionByName(inner).distinct()


def descendants(base_types: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(type, base) pairs of a type and all its bases, itself among them; of (column type): of these bases only."""
    if of is not None:
        of = of.select(F.col("type").alias("base")).where("base is not null").distinct()
        up = closure_to(base_types.where("base <> ''"), of, BASE_DEPTH, "type", "base").select("type", "base")
        return up.unionByName(of.select(F.col("base").alias("type"), "base"))
    up = closure(base_types.where("base <> ''"), BASE_DEPTH, "type", "base").select("type", "base")
    names = base_types.select("type").unionByName(base_types.select(F.col("base").alias("type"))).distinct()
    return up.unionByName(names.select("type", F.col("type").alias("base")))


def _rank(depth: Column, sub: int, key: Column, chain: Column, reason: Column) -> Column:
    return F.struct(depth.alias("depth"), F.lit(sub).alias("sub"), key.alias("key"), chain.alias("chain"), reason.alias("reason"))


def direct_hits(reached: DataFrame, tests: DataFrame) -> DataFrame:
    """Tests that the walk reaches."""
    seed = pretty_key(F.col("chain")[0])
    reason = F.when(F.col("depth") == 0, F.concat(F.lit("the test itself changed ("), seed, F.lit(")"))).otherwise(
        F.concat(seed, F.lit(" reaches this test in "), F.col("depth").cast("string"), F.lit(" hop(s)"))
    )
    hit = reached.join(tests, F.col("node") == F.col("key"))
    return hit.select(*[F.col(c) for c in tests.columns], F.lit(PHASE_WALK).alias("phase"), _rank(F.col("depth"), 0, F.col("node"), F.col("chain"), reason).alias("why"))


def _hooks(reached: DataFrame, lifecycle: DataFrame) -> DataFrame:
    text = F.when(F.col("scope") == SCOPE_GLOBAL, "global ").when(F.col("scope") == SCOPE_ASSEMBLY, "assembly-wide ").otherwise("")
    reason = F.concat(text, F.lit("lifecycle method "), pretty_key(F.col("node")), F.lit(" is impacted"))
    hit = reached.join(lifecycle, F.col("node") == F.col("method_key"))
    return hit.select("scope", "declaring_type", F.lower("assembly").alias("_asm"), _rank(F.col("depth"), 1, F.col("node"), F.col("chain"), reason).alias("why"))


def lifecycle_hits(reached: DataFrame, tests: DataFrame, lifecycle: DataFrame, below: DataFrame) -> DataFrame:
    """Tests within the scope of a lifecycle method that the walk reaches: of the declaring class and
    classes derived from it, of the assembly (without case), or all. Of each scope's hooks the
    nearest speaks, so each join meets one row for a class, an assembly, or the whole. below: descendants()."""
    hooks = _hooks(reached, lifecycle)
    cols = [F.col(c) for c in tests.columns] + [F.lit(PHASE_WALK).alias("phase"), F.col("why")]
    fixture = hooks.where(F.col("scope") == SCOPE_FIXTURE).groupBy("declaring_type").agg(F.min("why").alias("why"))
    below = below.select(F.col("type").alias("_t"), F.col("base").alias("_b"))
    derived = fixture.join(below, F.col("declaring_type") == F.col("_b")).select(F.col("_t").alias("_class"), "why")
    derived = derived.unionByName(fixture.select(F.col("declaring_type").alias("_class"), "why")).groupBy("_class").agg(F.min("why").alias("why"))
    one = derived.join(tests, F.col("_class") == F.col("declaring_type")).select(*cols)
    assembly = hooks.where(F.col("scope") == SCOPE_ASSEMBLY).groupBy("_asm").agg(F.min("why").alias("why"))
    two = assembly.join(tests, F.col("_asm") == F.lower("assembly")).select(*cols)
    whole = hooks.where(F.col("scope") == SCOPE_GLOBAL).agg(F.min("why").alias("why")).where("why is not null")
    three = tests.crossJoin(F.broadcast(whole)).select(*cols)  # one row at most
    return one.unionByName(two).unionByName(three)


def type_hits(seeded: DataFrame, tests: DataFrame, below: DataFrame) -> DataFrame:
    """Tests of classes that are, or derive from (below: descendants()), a changed type."""
    changed = seeded.where("type is not null").select("type").distinct()
    below = below.select(F.col("type").alias("_class"), F.col("base").alias("type"))
    every = changed.join(below, "type").select("_class", "type").unionByName(changed.select(F.col("type").alias("_class"), "type")).distinct()
    key = type_key(F.col("type"))
    why = _rank(F.lit(0), 0, key, F.array(key), F.concat(F.lit("the fixture is or inherits from changed type "), F.col("type")))
    first = every.select("_class", why.alias("why")).groupBy("_class").agg(F.min("why").alias("why"))
    return first.join(tests, F.col("_class") == F.col("declaring_type")).select(*[F.col(c) for c in tests.columns], F.lit(PHASE_SEED).alias("phase"), "why")


def provider_hits(seeded: DataFrame, tests: DataFrame, links: DataFrame) -> DataFrame:
    """Tests whose data provider changed itself."""
    plain = seeded.where("type is null").select(F.col("node").alias("provider_key")).distinct()
    key = F.col("provider_key")
    why = _rank(F.lit(0), 1, key, F.array(key, F.col("test_key")), F.concat(F.lit("data provider changed: "), pretty_key(key)))
    hit = plain.join(links, "provider_key").select("test_key", why.alias("why")).groupBy("test_key").agg(F.min("why").alias("why"))
    return hit.join(tests, F.col("test_key") == F.col("key")).select(*[F.col(c) for c in tests.columns], F.lit(PHASE_SEED).alias("phase"), "why")


def first_reason(hits: DataFrame) -> DataFrame:
    """One row for each test (assembly and display name): the first reason, by phase, depth, and key."""
    names = [c for c in hits.columns if c not in ("phase", "why")]
    best = hits.groupBy(*names).agg(F.min(F.struct("phase", "why")).alias("_best"))
    w = Window.partitionBy("assembly", "display_name").orderBy("_best", "key")
    best = best.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.select(*names, F.col("_best.why.reason").alias("reason"), F.col("_best.why.chain").alias("chain"))


def always_run(tests: DataFrame, patterns: list[str]) -> DataFrame:
    """Tests pinned by name wildcards, with the first pattern that matches."""
    hit, reason = F.lit(False), F.lit(None).cast("string")
    for p in reversed(patterns):
        match = F.col("display_name").rlike(wildcard_regex(p))
        hit, reason = hit | match, F.when(match, F.lit(f"always run: {p}")).otherwise(reason)
    return tests.where(hit).select("*", reason.alias("reason"), F.array().cast("array<string>").alias("chain")).dropDuplicates(["assembly", "display_name"])


def with_pins(selection: DataFrame, pins: DataFrame) -> DataFrame:
    """The selection and the pinned tests it lacks."""
    return selection.unionByName(pins.join(selection, ["assembly", "display_name"], "left_anti").select(*selection.columns))


def select_tests(reached: DataFrame, seeded: DataFrame, tests: DataFrame, lifecycle: DataFrame, below: DataFrame, links: DataFrame) -> DataFrame:
    """The selection: test columns, reason and chain. below: descendants() of the build's types."""
    hits = direct_hits(reached, tests).unionByName(lifecycle_hits(reached, tests, lifecycle, below))
    hits = hits.unionByName(type_hits(seeded, tests, below)).unionByName(provider_hits(seeded, tests, links))
    return first_reason(hits)
