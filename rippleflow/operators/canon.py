"""Canonical text of members and types, and their hashes.

A member's text is its signature, attributes, locals, instructions without no-ops and exception
regions; jumps name the target's place among the instructions that stay (the next one if the
target is a no-op, -1 if none follows). Generated code counts for the methods of its owner's
name. Everything is aggregation by member, so texts of one member meet, never those of a build.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_ordinals, owner_of_member, owner_of_type, short_hash
from .graph import user_types

#: Operand tags by operand kind (fixed values).
OPERAND_TAGS = {"m": "m:", "f": "f:", "t": "t:", "cs": "cs:", "s": "s:", "loc": "loc:", "par": "par:", "f4": "f4:", "f8": "f8:", "n": "n:", "o": "o:"}


def hex_flags(x: Column) -> Column:
    """Upper-case hex of a 32-bit number taken as unsigned."""
    return F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def instruction_lines(instructions: DataFrame) -> DataFrame:
    """(assembly, fqn, lines): each member's instructions in order, no-ops gone."""
    member = Window.partitionBy("assembly", "fqn").orderBy("offset")
    real = F.col("opcode") != "nop"
    numbered = instructions.withColumn("_n", F.sum(F.when(real, 1).otherwise(0)).over(member) - F.when(real, 1).otherwise(0))
    total = F.sum(F.when(real, 1).otherwise(0)).over(Window.partitionBy("assembly", "fqn"))
    # the ordinal of an offset: how many instructions that stay stand before it; -1 where none follows
    numbered = numbered.withColumn("_at", F.when(F.col("_n") < total, F.col("_n")).otherwise(-1))
    places = numbered.groupBy("assembly", "fqn").agg(F.map_from_entries(F.collect_list(F.struct("offset", "_at"))).alias("_places"))
    rows = numbered.where(real).join(places, ["assembly", "fqn"])
    jump = lambda o: F.coalesce(F.try_element_at("_places", o), F.lit(-1)).cast("string")
    tag = F.create_map(*[F.lit(x) for kv in OPERAND_TAGS.items() for x in kv])
    text = F.when(F.col("operand_kind") == "s", F.replace(F.col("operand"), F.lit("\n"), F.lit("\\n"))).otherwise(F.col("operand"))
    shown = (
        F.when(F.col("operand_kind") == "@", F.concat(F.lit("@"), jump(F.get("jumps", F.lit(0)))))
        .when(F.col("operand_kind") == "@[]", F.concat(F.lit("@["), F.array_join(F.transform("jumps", lambda o: F.concat(jump(o), F.lit(","))), ""), F.lit("]")))
        .when(F.col("operand_kind").isNull(), F.lit(""))
        .otherwise(F.concat(F.try_element_at(tag, F.col("operand_kind")), text))
    )
    line = F.concat(F.col("opcode"), F.lit(" "), shown, F.lit("\n"))
    ordered = F.sort_array(F.collect_list(F.struct("offset", line.alias("line"))))
    return rows.groupBy("assembly", "fqn").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("lines"))


def attribute_lines(attributes: DataFrame) -> DataFrame:
    """(assembly, owner_kind, owner, lines): an owner's attributes, rendered and sorted.

    An attribute whose arguments could not be read is rendered by its raw bytes.
    """
    args = F.array_join(F.transform("args", lambda a: F.concat(F.lit("|a:"), F.substring(a, 3, 1 << 20))), "")
    named = F.array_join(F.transform(F.sort_array("named"), lambda n: F.concat(F.lit("|n:"), F.regexp_replace(n, "^([^=]*=)[a-z]:", "$1"))), "")
    line = F.when(F.col("args").isNull(), F.concat(F.lit("cab|"), F.col("attribute"), F.lit("|"), F.coalesce("raw", F.lit("")))).otherwise(F.concat(F.lit("ca|"), F.col("attribute"), args, F.coalesce(named, F.lit(""))))
    lines = F.sort_array(F.collect_list(F.concat(line, F.lit("\n"))))
    return attributes.groupBy("assembly", "owner_kind", "owner").agg(F.array_join(lines, "").alias("lines"))


def member_texts(members: DataFrame, instructions: DataFrame, attributes: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """(assembly, fqn, text). extras (assembly, fqn, locals, regions) adds rendered locals and regions."""
    code = instruction_lines(instructions)
    marks = attribute_lines(attributes).where("owner_kind = 'member'").select("assembly", F.col("owner").alias("fqn"), F.col("lines").alias("marks"))
    out = members.join(code, ["assembly", "fqn"], "left").join(marks, ["assembly", "fqn"], "left")
    if extras is not None:
        out = out.join(extras.select("assembly", "fqn", "locals", "regions"), ["assembly", "fqn"], "left")
    else:
        out = out.withColumns({"locals": F.lit(None).cast("string"), "regions": F.lit(None).cast("string")})
    sig = F.concat(F.lit("sig|"), F.col("fqn"), F.lit("|ga:"), F.col("arity").cast("string"), F.lit("|fl:"), hex_flags(F.col("flags")), F.lit("\n"))
    empty = F.lit("")
    text = F.concat(sig, F.coalesce("marks", empty), F.coalesce(F.concat(F.lit("locals|"), F.col("locals"), F.lit("\n")), empty), F.coalesce("lines", empty), F.coalesce("regions", empty))
    return out.select("assembly", "fqn", normalize_ordinals(text).alias("text"))


def type_texts(types: DataFrame, interfaces: DataFrame, fields: DataFrame, attributes: DataFrame) -> DataFrame:
    """(assembly, type, text) of a type's structure; its methods are no part of it."""
    own = ["assembly", "type"]
    face = interfaces.groupBy(*own).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("iface|"), F.col("interface"), F.lit("\n")))), "").alias("faces"))
    const = F.coalesce(F.concat(F.lit("|const:"), F.col("constant")), F.lit(""))
    line = F.concat(F.lit("field|"), F.col("name"), F.lit("|"), F.col("field_type"), F.lit("|fl:"), hex_flags(F.col("flags")), const, F.lit("\n"))
    field = fields.groupBy(*own).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), "").alias("fields"))
    marks = attribute_lines(attributes).where("owner_kind = 'type'").select("assembly", F.col("owner").alias("type"), F.col("lines").alias("marks"))
    head = F.concat(F.lit("type|"), F.col("type"), F.lit("|fl:"), hex_flags(F.col("flags")), F.lit("|ga:"), F.col("arity").cast("string"), F.lit("|base:"), F.coalesce(F.nullif("base", F.lit("")), F.lit("-")), F.lit("\n"))
    out = types.join(face, own, "left").join(field, own, "left").join(marks, own, "left")
    text = F.concat(head, *[F.coalesce(c, F.lit("")) for c in ("faces", "fields", "marks")])
    return out.select("assembly", "type", normalize_ordinals(text).alias("text"))


def contributions(own: DataFrame, contribs: DataFrame) -> DataFrame:
    """(assembly, fqn, hash, token): own rows (assembly, type, name, fqn, text, token) with what generated code adds to them.

    contribs (assembly, type, owner, fqn, hash) counts for every member of the owner's name; one whose
    owner is not there stands as a row of its own with token 0. Equal names keep all their hashes.
    """
    line = F.concat(F.lit("\ncontrib|"), F.col("fqn"), F.lit("|"), F.col("hash"))
    added = contribs.groupBy("assembly", "type", F.col("owner").alias("name")).agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("more"))
    rows = own.join(added, ["assembly", "type", "name"], "left").select("assembly", "fqn", short_hash(F.concat("text", F.coalesce("more", F.lit("")))).alias("hash"), "token")
    orphans = contribs.join(own.select("assembly", "type", F.col("name").alias("owner")).distinct(), ["assembly", "type", "owner"], "left_anti")
    return rows.unionByName(orphans.groupBy("assembly", "fqn").agg(F.min("hash").alias("hash")).select("assembly", "fqn", "hash", F.lit(0).alias("token")))


def hash_members(types: DataFrame, members: DataFrame, instructions: DataFrame, interfaces: DataFrame, fields: DataFrame, attributes: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """(assembly, fqn, hash, token) of a build's members and types, by the rules above."""
    text = member_texts(members, instructions, attributes, extras)
    user = user_types(types)
    m = members.join(text, ["assembly", "fqn"]).join(user, "type").join(types.select("assembly", "type", "simple_name"), ["assembly", "type"])
    owner = F.coalesce(owner_of_member(F.col("name")), F.when(F.col("type") != F.col("user_type"), owner_of_type(F.col("simple_name"))))
    m = m.withColumn("owner", owner)
    fqn = normalize_ordinals(F.col("fqn"))
    plain = m.where((F.col("type") == F.col("user_type")) & F.col("owner").isNull()).select("assembly", "type", "name", fqn.alias("fqn"), "text", "token")
    shape = type_texts(types.join(user.where("type = user_type").select("type"), "type", "left_semi"), interfaces, fields, attributes)
    shaped = shape.select("assembly", "type", F.lit("::<type>").alias("name"), normalize_ordinals(F.concat("type", F.lit("::<type>"))).alias("fqn"), "text", F.lit(0).alias("token"))
    parts = m.where("owner is not null").select("assembly", F.col("user_type").alias("type"), "owner", fqn.alias("fqn"), short_hash(F.col("text")).alias("hash"))
    return contributions(plain.unionByName(shaped), parts)
