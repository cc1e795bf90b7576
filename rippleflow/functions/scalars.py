"""Scalar rules as Column functions. Patterns are compiled on the driver; rows never leave the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE_PREFIX = "TN:"
#: Ordinals in generated names: (what stands before, pattern, replacement). Fixed values.
ORDINALS = [
    (r"(?<=>b__)[0-9]+_", "#_"),
    (r"(?<=>d__)[0-9]+", "#"),
    (r"(?<=c__DisplayClass)[0-9]+_", "#_"),
    (r"(?<=<>9__)[0-9]+_", "#_"),
    (r"(?<=g__[A-Za-z0-9_]{1,200}\|)[0-9]+_", "#_"),
]
_JAVA_SPECIAL = set("\\.[]{}()*+-?^$|&#~ \t")


def _escaped(c: str) -> str:
    return "\\" + c if c in _JAVA_SPECIAL else c


def glob_regex(glob: str, flags: str = "(?iu)") -> str:
    """Anchored regex of a path glob: **/ any folders, ** anything, * and ? within a segment."""
    g, out, i = glob.replace("\\", "/"), [], 0
    while i < len(g):
        for token, regex in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if g.startswith(token, i):
                out.append(regex)
                i += len(token)
                break
        else:
            out.append(_escaped(g[i]))
            i += 1
    return f"{flags}^{''.join(out)}$"


def wildcard_regex(pattern: str, flags: str = "(?iu)") -> str:
    """Anchored regex of a name wildcard: * anything, ? one character."""
    return f"{flags}^{''.join({'*': '.*', '?': '.'}.get(c) or _escaped(c) for c in pattern)}$"


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def glob_match(path: Column, glob: str) -> Column:
    return slashed(path).rlike(glob_regex(glob))


def in_scope(name: Column, has_symbols: Column, include: list[str], exclude: list[str]) -> Column:
    """Excluded names are out; with an include list only its names are in; else those with symbols."""
    out = F.lit(False)
    for g in exclude:
        out = out | glob_match(name, g)
    if not include:
        return ~out & has_symbols
    hit = F.lit(False)
    for g in include:
        hit = hit | glob_match(name, g)
    return ~out & hit


def scope_text(include: list[str], exclude: list[str]) -> str:
    """A stable description of a scope."""
    return f"include=[{','.join(include)}] exclude=[{','.join(exclude)}]" if include or exclude else "pdb-adjacent"


def normalize_ordinals(text: Column) -> Column:
    for pattern, new in ORDINALS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(new))
    return text


def owner_of_member(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "^<([^>]+)>[bg]__", 1), F.lit(""))


def owner_of_type(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "^<([^>]+)>d__[0-9]+", 1), F.lit(""))


def is_generated(name: Column) -> Column:
    return name.startswith("<")


def method_key(type_: Column, name: Column, params: Column) -> Column:
    return normalize_ordinals(F.concat(type_, F.lit("::"), name, F.lit("/"), params.cast("string")))


def type_key(type_: Column) -> Column:
    return F.concat(F.lit(TYPE_PREFIX), type_)


def param_count(args: Column) -> Column:
    """Parameters in an argument list: commas outside < > and [ ], plus one unless it is empty."""
    step = F.aggregate(
        F.split(args, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")),
        lambda a, c: F.struct(
            (a["depth"] + F.when(c.isin("<", "["), 1).when(c.isin(">", "]"), -1).otherwise(0)).alias("depth"),
            (a["n"] + F.when((c == ",") & (a["depth"] == 0), 1).otherwise(0)).alias("n"),
        ),
        lambda a: a["n"] + 1,
    )
    return F.when(F.length(args) == 0, F.lit(0)).otherwise(step)


def key_of_fqn(fqn: Column) -> Column:
    """Node key of a full name: return type and modifiers go, overloads of one arity fall together.

    What stands before :: ends with the declaring type, behind the last space. Names ending in
    ::<type> give type nodes. A name without :: has no key (null).
    """
    head, tail = F.substring_index(fqn, "::", 1), F.expr("''")
    tail = F.substring(fqn, F.length(head) + 3, F.length(fqn))
    owner = F.substring_index(head, " ", -1)
    name = F.substring_index(tail, "(", 1)
    args = F.regexp_extract(tail, r"^[^(]*\((.*)\)$", 1)
    method = method_key(owner, name, F.when(tail.contains("("), param_count(args)).otherwise(F.lit(0)))
    return F.when(~fqn.contains("::"), F.lit(None).cast("string")).when(fqn.endswith("::<type>"), type_key(owner)).otherwise(method)


def member_name(key: Column) -> Column:
    """The name between :: and the last / of a node key."""
    return F.regexp_extract(key, "::(.*)/[^/]*$", 1)


def path_matches(document: Column, path: Column) -> Column:
    """Whether a changed path is a document's path or ends it at a segment's border, without case;
    once more with the changed path's first segment gone."""
    doc, p = F.lower(slashed(document)), F.ltrim(F.lower(slashed(path)), F.lit("/"))
    rest = F.when(p.contains("/"), F.substring(p, F.instr(p, "/") + 1, F.length(p)))
    hit = lambda q: (doc == q) | doc.endswith(F.concat(F.lit("/"), q))
    return (F.length(p) > 0) & (hit(p) | ((F.length(rest) > 0) & F.coalesce(hit(rest), F.lit(False))))


def base_name(path: Column) -> Column:
    return F.lower(F.substring_index(slashed(path), "/", -1))


def version_of(tfm: Column) -> Column:
    """A framework name's version as integers; [0, 0] if it has none that parses."""
    v = F.regexp_extract(tfm, r"Version=v?([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(v == "", F.array(F.lit(0), F.lit(0))).otherwise(F.split(v, r"\.").cast("array<int>"))


def leaf_name(display: Column, parameterized: Column) -> Column:
    return F.concat(F.substring_index(display, ".", -1), F.when(parameterized, F.lit("*")).otherwise(F.lit("")))


def display_name(type_: Column, method: Column) -> Column:
    return F.concat(F.replace(type_, F.lit("/"), F.lit("+")), F.lit("."), method)


def escape_filter(text: Column) -> Column:
    r"""The test platform's filter escape: a backslash before \ ( ) & | = ! ~ (fixed values)."""
    return F.regexp_replace(text, r"([\\()&|=!~])", r"\\$1")


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def pretty_key(key: Column) -> Column:
    """A node key for readers: [type T], or T.M without the arity."""
    plain = F.replace(F.when(F.instr(key, "/") > 1, F.regexp_replace(key, "/[^/]*$", "")).otherwise(key), F.lit("::"), F.lit("."))
    return F.when(key.startswith(TYPE_PREFIX), F.concat(F.lit("[type "), F.substring(key, len(TYPE_PREFIX) + 1, F.length(key)), F.lit("]"))).otherwise(plain)


def short_hash(text: Column) -> Column:
    """SHA-256 in upper-case hex, its first 16 bytes."""
    return F.upper(F.substring(F.sha2(text, 256), 1, 32))


def identity_of(content_hash: Column, mvid: Column) -> Column:
    return F.coalesce(F.nullif(content_hash, F.lit("")), mvid)


def tfm_of(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def is_solution(path: Column) -> Column:
    return F.lower(path).rlike(r"\.slnx?$")


def first_few(items: list[str], most: int = 5) -> str:
    """The first few names, and how many more there are."""
    more = f" +{len(items) - most} more" if len(items) > most else ""
    return ", ".join(items[:most]) + more


def re2_glob(glob: str) -> str:
    """The same regex for engines without flags for other alphabets."""
    return re.sub(r"^\(\?iu\)", "(?i)", glob_regex(glob))
