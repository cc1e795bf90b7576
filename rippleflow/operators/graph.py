"""Dependency edges from structural facts. An edge (callee, caller, kind) points where impact flows.

Facts are relations by assembly (see schemas); all steps are joins and projections. The deeper
hierarchies (declaring types, bases) are closed once, by doubling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_generated, member_name, method_key, owner_of_member, owner_of_type, type_key
from .reach import closure

#: Base types of web controllers, which the host calls (fixed values).
CONTROLLERS = ("Microsoft.AspNetCore.Mvc.ControllerBase", "Microsoft.AspNetCore.Mvc.Controller")
BASE_DEPTH, CONTROLLER_DEPTH, NESTING = 64, 16, 16


def _edge(callee: Column, caller: Column, kind: str) -> list[Column]:
    return [callee.alias("callee"), caller.alias("caller"), F.lit(kind).alias("kind")]


def user_types(types: DataFrame) -> DataFrame:
    """(type, user_type): the nearest declaring type that the compiler did not generate.

    Top-level generated types have none and are left out.
    """
    up = closure(types.where("declaring_type is not null").select("type", F.col("declaring_type").alias("over")), NESTING, "type", "over")
    user = types.where(~is_generated(F.col("simple_name"))).select(F.col("type").alias("user_type"))
    own = user.select(F.col("user_type").alias("type"), "user_type")
    generated = types.where(is_generated(F.col("simple_name"))).select("type")
    near = up.join(user, F.col("over") == F.col("user_type")).join(generated, "type", "left_semi").groupBy("type").agg(F.min_by("user_type", "depth").alias("user_type"))
    return own.unionByName(near).distinct()


def identities(types: DataFrame, members: DataFrame) -> DataFrame:
    """(assembly, fqn, key, user_type, generated): the node keys that a member acts as.

    Generated members act as the methods of their owner's name, all overloads, or as owner/0 if there
    is none. Generated code without an owner has no identity.
    """
    m = members.join(user_types(types), "type").join(types.select("type", "simple_name"), "type")
    nested = F.col("type") != F.col("user_type")
    owner = F.coalesce(owner_of_member(F.col("name")), F.when(nested, owner_of_type(F.col("simple_name"))))
    m = m.withColumn("owner", owner).where(F.col("owner").isNotNull() | ~nested)
    plain = m.where("owner is null").select("assembly", "fqn", method_key(F.col("type"), F.col("name"), F.col("params")).alias("key"), "user_type", F.lit(False).alias("generated"))
    named = members.select(F.col("type").alias("user_type"), F.col("name").alias("owner"), method_key(F.col("type"), F.col("name"), F.col("params")).alias("owner_key")).distinct()
    made = m.where("owner is not null").join(named, ["user_type", "owner"], "left")
    key = F.coalesce("owner_key", method_key(F.col("user_type"), F.col("owner"), F.lit(0)))
    return plain.unionByName(made.select("assembly", "fqn", key.alias("key"), "user_type", F.lit(True).alias("generated")))


def body_edges(instructions: DataFrame, callers: DataFrame, scope: DataFrame) -> DataFrame:
    """Calls, generic arguments and field accesses, to assemblies in scope (column name).

    A bare type operand gives no edge. A type argument's edge leads from its type node.
    """
    code = instructions.join(callers.select("assembly", "fqn", "key"), ["assembly", "fqn"])
    inside = scope.select(F.lower("name").alias("_s"))
    near = code.join(inside, F.lower("target_scope") == F.col("_s"), "left_semi")
    calls = near.where("operand_kind = 'm'").select(*_edge(method_key(F.col("target_type"), F.col("target_name"), F.col("target_params")), F.col("key"), "call"))
    fields = near.where("operand_kind = 'f'").select(*_edge(type_key(F.col("target_type")), F.col("key"), "field"))
    args = code.where("operand_kind in ('m', 'f')").select("key", F.explode("type_args").alias("arg")).where(~F.col("arg").rlike("(^|/)<|^!"))
    return calls.unionByName(fields).unionByName(args.select(*_edge(type_key(F.col("arg")), F.col("key"), "generic")))


def member_edges(callers: DataFrame) -> DataFrame:
    """Every member reaches its type's node."""
    return callers.select(*_edge(F.col("key"), type_key(F.col("user_type")), "member")).distinct()


def controller_edges(types: DataFrame, members: DataFrame) -> DataFrame:
    """Members of web controllers reach their assembly's entry point."""
    bases = closure(types.where("base <> ''").select("type", "base"), CONTROLLER_DEPTH, "type", "base")
    web = bases.where(F.col("base").isin(*CONTROLLERS)).select("type").distinct()
    start = types.where("entry_point is not null").select("assembly", "entry_point").distinct()
    m = members.join(web, "type", "left_semi").join(start, "assembly")
    return m.select(*_edge(method_key(F.col("type"), F.col("name"), F.col("params")), F.col("entry_point"), "controller"))


def polymorphism_edges(types: DataFrame, members: DataFrame, interfaces: DataFrame, overrides: DataFrame) -> DataFrame:
    """An implementation reaches what it implements or overrides: declared overrides, interface
    methods of the type and its bases (and what those interfaces extend) of the same name and arity,
    and virtual methods of ancestors as far as these are in the facts. Members of equal keys count once."""
    key = method_key(F.col("type"), F.col("name"), F.col("params"))
    declared = overrides.select(*_edge(F.col("member_key"), F.col("overridden_key"), "override"))
    virtual = members.where("is_virtual and not is_static and not is_ctor").select("type", "name", "params", key.alias("key")).distinct()
    known = types.select(F.col("type").alias("base"))
    up = closure(types.where("base <> ''").select("type", "base").join(known, "base", "left_semi"), BASE_DEPTH, "type", "base").select("type", "base")
    own = types.select("type", F.col("type").alias("base"))
    of = interfaces.select(F.col("type").alias("base"), "interface")
    direct = up.unionByName(own).join(of, "base").select("type", "interface")
    more = direct.join(of.select(F.col("base").alias("interface"), F.col("interface").alias("over")), "interface").select("type", F.col("over").alias("interface"))
    every = direct.unionByName(more).distinct()
    target = members.select(F.col("type").alias("interface"), "name", "params", key.alias("target")).distinct()
    implicit = virtual.join(every, "type").join(target, ["interface", "name", "params"]).select(*_edge(F.col("key"), F.col("target"), "interface"))
    above = members.where("is_virtual and not is_static").select(F.col("type").alias("base"), "name", "params", key.alias("target")).distinct()
    overriding = virtual.join(up, "type").join(above, ["base", "name", "params"]).select(*_edge(F.col("key"), F.col("target"), "virtual"))
    return declared.unionByName(implicit).unionByName(overriding)


def fixture_edges(fixtures: DataFrame, members: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Every member and the type node of a fixture that the runner builds (type, fixture) reaches
    each lifecycle method of the class that receives it."""
    hooks = lifecycle.select(F.col("declaring_type").alias("type"), "method_key")
    to = fixtures.select("type", "fixture").distinct().join(hooks, "type")
    keys = members.select(F.col("type").alias("fixture"), method_key(F.col("type"), F.col("name"), F.col("params")).alias("key"))
    whole = to.select(*_edge(type_key(F.col("fixture")), F.col("method_key"), "fixture"))
    return to.join(keys, "fixture").select(*_edge(F.col("key"), F.col("method_key"), "fixture")).unionByName(whole)


def provider_links(refs: DataFrame, type_members: DataFrame) -> DataFrame:
    """(provider_key, test_key): * stands for all members of the type; else members of that name, or
    property getters of it. A name that nothing has falls back to the whole type."""
    wild = refs.where("member = '*'").join(type_members, "type").select(F.col("member_key").alias("provider_key"), "test_key")
    named = refs.where("member <> '*'")
    names = type_members.withColumn("member", F.explode(F.array(member_name(F.col("member_key")), F.regexp_extract(member_name(F.col("member_key")), "^get_(.*)$", 1)))).where("member <> ''")
    hit = named.join(names, ["type", "member"]).select("type", "member", F.col("member_key").alias("provider_key"), "test_key")
    miss = named.join(hit, ["type", "member", "test_key"], "left_anti")
    whole = miss.join(type_members, "type").select(F.col("member_key").alias("provider_key"), "test_key")
    return reduce(DataFrame.unionByName, [wild, hit.select("provider_key", "test_key"), whole]).distinct()


def provider_edges(links: DataFrame) -> DataFrame:
    """A provider that the walk reaches reaches its tests."""
    return links.select(*_edge(F.col("provider_key"), F.col("test_key"), "provider"))


def frameworks_present(references: DataFrame, markers: DataFrame) -> DataFrame:
    """(assembly, framework) of assemblies that refer to a framework's marker, without case."""
    m = F.broadcast(markers.select(F.lower("marker").alias("_m"), "framework"))  # one row for each known marker
    return references.join(m, F.lower("ref") == F.col("_m")).select(F.col("name").alias("assembly"), "framework").distinct()


def type_members(members: DataFrame) -> DataFrame:
    """(type, member_key) of members that were written, not generated."""
    own = members.where(owner_of_member(F.col("name")).isNull())
    return own.select("type", method_key(F.col("type"), F.col("name"), F.col("params")).alias("member_key")).distinct()


def merged(parts: list[DataFrame]) -> DataFrame:
    """The union of edge sets: no self edges, each pair once, under its least kind."""
    every = reduce(DataFrame.unionByName, parts).where("callee <> caller")
    return every.groupBy("callee", "caller").agg(F.min("kind").alias("kind"))


def base_types(types: DataFrame) -> DataFrame:
    """(type, base) by open names: a base's type arguments are cut off."""
    return types.where("base <> ''").select("type", F.regexp_replace("base", r"<.*>$", "").alias("base"))


def build(types: DataFrame, members: DataFrame, instructions: DataFrame, interfaces: DataFrame, overrides: DataFrame, scope: DataFrame, lifecycle: DataFrame, fixtures: DataFrame, refs: DataFrame) -> DataFrame:
    """All edges of a build."""
    callers = identities(types, members)
    return merged(
        [
            body_edges(instructions, callers, scope),
            member_edges(callers),
            controller_edges(types, members),
            polymorphism_edges(types, members, interfaces, overrides),
            fixture_edges(fixtures, members, lifecycle),
            provider_edges(provider_links(refs, type_members(members))),
        ]
    )


