"""Registered queries: each operator over the adapters of testdata, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as S
from ..operators import canon, diff, emit, graph, ranges, reach, rules, select
from ..sources import cache, changes, listing, solution
from .analyze import ladder_column
from .testdata import Relations, duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GLOBS = ["**/fr/*", "http?://m.**", "**/*.html"]
PINS = ["Customer#?????00?7", "*9?1", "customer#00000?4*"]


def query(name: str, oracle: str | None = None):
    """Registers a function of Relations under a name, with its SQL."""

    def add(f: Callable[[Relations], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# -- diffs -----------------------------------------------------------------------------------

_ASM = """+asm AS (
  SELECT coalesce(c.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN c.name IS NULL THEN 'removed' WHEN lower(b.content_hash) = lower(c.content_hash) THEN 'unchanged' ELSE 'changed' END AS status
  FROM assembly_base b FULL OUTER JOIN assembly_cur c ON lower(b.name) = lower(c.name))"""
_METHODS = (
    _ASM
    + """, b AS (SELECT lower(assembly) AS a, fqn, hash FROM method_base WHERE lower(assembly) IN (SELECT lower(name) FROM asm WHERE status = 'changed')),
  c AS (SELECT lower(assembly) AS a, fqn, hash FROM method_cur WHERE lower(assembly) IN (SELECT lower(name) FROM asm WHERE status IN ('changed', 'added'))),
  d AS (SELECT coalesce(b.a, c.a) AS a, coalesce(b.fqn, c.fqn) AS fqn, CASE WHEN b.fqn IS NULL THEN 'added' WHEN c.fqn IS NULL THEN 'removed' WHEN b.hash <> c.hash THEN 'changed' END AS k FROM b FULL OUTER JOIN c ON b.a = c.a AND b.fqn = c.fqn),
  changes AS (SELECT asm.name AS assembly, fqn, CASE WHEN fqn LIKE '%::<type>' AND k <> 'removed' THEN 'type' ELSE k END AS kind FROM d JOIN asm ON lower(asm.name) = a WHERE k IS NOT NULL)"""
)
_SNAP = ["assembly_base", "assembly_cur"]


def _report(r: Relations) -> DataFrame:
    return diff.diff_assemblies(r["assembly_base"], r["assembly_cur"])


def _changes(r: Relations) -> DataFrame:
    return diff.diff_methods(r["method_base"], r["method_cur"], _report(r))


@query("assembly_diff", duck(_SNAP, _ASM + " SELECT * FROM asm"))
def _(r):
    return _report(r)


@query("method_diff", duck(_SNAP, _METHODS + " SELECT * FROM changes"))
def _(r):
    return _changes(r)


@query("method_diff_counts", duck(_SNAP, _METHODS + " SELECT assembly, kind, count(*) AS n FROM changes GROUP BY assembly, kind"))
def _(r):
    return _changes(r).groupBy("assembly", "kind").agg(F.count("*").alias("n"))


@query(
    "content_diff",
    duck(
        ["content_base", "content_cur"],
        "SELECT coalesce(c.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN c.name IS NULL THEN 'removed' ELSE 'changed' END AS status FROM content_base b FULL OUTER JOIN content_cur c ON lower(b.name) = lower(c.name) WHERE b.name IS NULL OR c.name IS NULL OR b.hash <> c.hash",
    ),
)
def _(r):
    return diff.diff_content(r["content_base"], r["content_cur"])[0]


@query("content_diff_version_gate", duck(["content_cur"], "SELECT count(*) * 0 AS n_differences, count(*) > 0 AS warned FROM content_cur"))
def _(r):
    rows, warned = diff.diff_content(r["content_base"], r["content_cur"], version=3)
    return rows.agg(F.count("*").alias("n_differences"), F.lit(warned).alias("warned"))


@query(
    "untraceable",
    duck(_SNAP, _ASM + " SELECT min(name) AS name FROM asm WHERE status IN ('changed', 'added') AND lower(name) NOT IN (SELECT lower(name) FROM assembly_cur WHERE methods_analyzed) GROUP BY lower(name)"),
)
def _(r):
    return diff.untraceable(_report(r).where("status in ('changed', 'added')").select("name"), r["assembly_cur"])


@query(
    "reuse_method_hashes",
    duck(
        [*_SNAP, "method_base"],
        "SELECT c.name AS assembly, m.token, m.fqn, m.hash FROM assembly_cur c JOIN assembly_base b ON lower(b.name) = lower(c.name) AND b.content_hash = c.content_hash AND b.methods_analyzed JOIN method_base m ON m.assembly = b.name WHERE CAST(substr(c.name, 2) AS INT) % 3 <> 2",
    ),
)
def _(r):
    current = r["assembly_cur"].withColumn("in_scope", F.expr("CAST(substr(name, 2) AS INT) % 3 <> 2"))
    return diff.reuse(current, r["assembly_base"], r["method_base"])[0]


@query(
    "left_to_hash",
    duck(
        _SNAP,
        "SELECT c.name FROM assembly_cur c WHERE CAST(substr(c.name, 2) AS INT) % 3 <> 2 AND NOT EXISTS (SELECT 1 FROM assembly_base b WHERE lower(b.name) = lower(c.name) AND b.content_hash = c.content_hash AND b.methods_analyzed)",
    ),
)
def _(r):
    current = r["assembly_cur"].withColumn("in_scope", F.expr("CAST(substr(name, 2) AS INT) % 3 <> 2"))
    return diff.reuse(current, r["assembly_base"], r["method_base"])[1].select("name")


# -- which copy counts -----------------------------------------------------------------------


def _copy(order: str) -> str:
    return duck(["version"], f"SELECT file, dir_index, path, modified FROM (SELECT *, row_number() OVER (PARTITION BY lower(file) ORDER BY {order}) AS n FROM version) WHERE n = 1")


@query("newest_copy", _copy("modified DESC, dir_index, path"))
def _(r):
    return listing.newest(r["version"])


@query("first_copy", _copy("dir_index, path"))
def _(r):
    return listing.first(r["version"])


@query("first_assembly", duck(["version"], "SELECT lower(file) AS name, min(path) AS path FROM version GROUP BY lower(file)"))
def _(r):
    return listing.first_assembly(r["version"].select(F.lower("file").alias("name"), "path"))


# -- reachability ----------------------------------------------------------------------------

_WALK = """+walk(node, depth, chain) AS (
  SELECT node, 0, [node] FROM seed
  UNION ALL SELECT e.caller, w.depth + 1, list_append(w.chain, e.caller) FROM walk w JOIN edge e ON e.callee = w.node),
reached AS (SELECT node, min(depth) AS depth, min(chain) AS chain FROM walk GROUP BY node)"""


def _reached(r: Relations) -> DataFrame:
    return reach.reach(r["edge"], r["seed"])


@query("impact_reach", duck(["edge", "seed"], "+walk(node) AS (SELECT node FROM seed UNION SELECT e.caller FROM walk w JOIN edge e ON e.callee = w.node) SELECT node FROM walk", True))
def _(r):
    return reach.reach(r["edge"], r["seed"], chains=False).select("node")


@query("impact_reach_depth", duck(["edge", "seed"], "+walk(node, depth) AS (SELECT node, 0 FROM seed UNION SELECT e.caller, w.depth + 1 FROM walk w JOIN edge e ON e.callee = w.node) SELECT node, min(depth) AS depth FROM walk GROUP BY node", True))
def _(r):
    return reach.reach(r["edge"], r["seed"], chains=False)


@query("impact_chain", duck(["edge", "seed"], _WALK + " SELECT node, depth, array_to_string(chain, ' > ') AS chain FROM reached", True))
def _(r):
    return _reached(r).withColumn("chain", F.array_join("chain", " > "))


@query(
    "impact_reach_cyclic",
    duck(["edge_cyclic", "seed"], "+walk(node) AS (SELECT node FROM seed UNION SELECT e.caller FROM walk w JOIN edge_cyclic e ON e.callee = w.node) SELECT node FROM walk", True),
)
def _(r):
    return reach.reach(r["edge_cyclic"], r["seed"], chains=False).select("node")


@query(
    "reference_closure",
    duck(["ref"], "+low AS (SELECT DISTINCT lower(name) AS name, lower(ref) AS ref FROM ref), walk(name, ref) AS (SELECT name, ref FROM low UNION SELECT w.name, l.ref FROM walk w JOIN low l ON l.name = w.ref) SELECT name, ref FROM walk WHERE name <> ref", True),
)
def _(r):
    return reach.reference_closure(r["ref"])


_UP = "up(type, base, depth) AS (SELECT type, base, 1 FROM base_type UNION ALL SELECT u.type, b.base, u.depth + 1 FROM up u JOIN base_type b ON b.type = u.base WHERE u.depth < 64)"


@query("ancestor_closure", duck(["base_type"], f"+{_UP} SELECT type, base, min(depth) AS depth FROM up WHERE type <> base GROUP BY type, base", True))
def _(r):
    return reach.closure(r["base_type"], 64, "type", "base")


# -- selection -------------------------------------------------------------------------------

_SELECT = ["edge", "seed", "test", "lifecycle", "base_type", "hook_global"]
_BELOW = f"{_UP}, below AS (SELECT type, base FROM up UNION SELECT type, type FROM base_type UNION SELECT base, base FROM base_type)"


@query("select_direct", duck(_SELECT, _WALK + " SELECT display_name, assembly, depth AS hops FROM reached JOIN test ON node = key", True))
def _(r):
    return select.direct_hits(_reached(r), r["test"]).select("display_name", "assembly", F.col("why.depth").alias("hops"))


_HIT = " SELECT DISTINCT t.display_name, t.assembly FROM reached JOIN {hook} h ON h.method_key = node {join} WHERE h.scope = {scope}"


def _below(r: Relations, hooks: DataFrame) -> DataFrame:
    """The classes below those whose hooks count for their own class."""
    return select.descendants(r["base_type"], hooks.where(F.col("scope") == schemas.SCOPE_FIXTURE).select(F.col("declaring_type").alias("type")))


def _lifecycle(r: Relations, hooks: str, scope: int) -> DataFrame:
    own = r[hooks].where(F.col("scope") == scope)
    hit = select.lifecycle_hits(_reached(r), r["test"], own, _below(r, own))
    return hit.select("display_name", "assembly").distinct()


@query("select_fixture", duck(_SELECT, _WALK + ", " + _BELOW + _HIT.format(hook="lifecycle", join="JOIN below b ON b.base = h.declaring_type JOIN test t ON t.declaring_type = b.type", scope=1), True))
def _(r):
    return _lifecycle(r, "lifecycle", 1)


@query("select_assembly", duck(_SELECT, _WALK + _HIT.format(hook="lifecycle", join="JOIN test t ON lower(t.assembly) = lower(h.assembly)", scope=2), True))
def _(r):
    return _lifecycle(r, "lifecycle", 2)


@query("select_global", duck(_SELECT, _WALK + _HIT.format(hook="hook_global", join="CROSS JOIN test t", scope=3), True))
def _(r):
    return _lifecycle(r, "hook_global", 3)


_FIRST = (
    _WALK
    + ", "
    + _BELOW
    + """, hit AS (
  SELECT t.assembly, t.display_name, r.depth, 0 AS sub, r.node FROM reached r JOIN test t ON t.key = r.node
  UNION ALL SELECT t.assembly, t.display_name, r.depth, 1, r.node FROM reached r JOIN lifecycle h ON h.method_key = r.node AND h.scope = 1 JOIN below b ON b.base = h.declaring_type JOIN test t ON t.declaring_type = b.type
  UNION ALL SELECT t.assembly, t.display_name, r.depth, 1, r.node FROM reached r JOIN lifecycle h ON h.method_key = r.node AND h.scope = 2 JOIN test t ON lower(t.assembly) = lower(h.assembly)),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY assembly, display_name ORDER BY depth, sub, node) AS n FROM hit) WHERE n = 1)"""
)


def _chosen(r: Relations) -> DataFrame:
    reached = _reached(r)
    hits = select.direct_hits(reached, r["test"]).unionByName(select.lifecycle_hits(reached, r["test"], r["lifecycle"], _below(r, r["lifecycle"])))
    return select.first_reason(hits)


@query("select_first_reason", duck(_SELECT, _FIRST + " SELECT assembly, display_name, node, depth AS hops FROM chosen", True))
def _(r):
    return _chosen(r).select("assembly", "display_name", F.element_at("chain", -1).alias("node"), (F.size("chain") - 1).alias("hops"))


def _pin(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{S.wildcard_regex(p, '(?i)')}') THEN '{p}'" for p in PINS) + " END"


@query("always_run", duck(["test"], f"SELECT * FROM (SELECT display_name, {_pin('display_name')} AS pattern FROM test) WHERE pattern IS NOT NULL"))
def _(r):
    return select.always_run(r["test"], PINS).select("display_name", F.regexp_replace("reason", "^always run: ", "").alias("pattern"))


@query(
    "selection_with_pins",
    duck(_SELECT, _FIRST + f" SELECT assembly, display_name, false AS pinned FROM chosen UNION ALL SELECT assembly, display_name, true FROM test t WHERE {_pin('display_name')} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.assembly = t.assembly AND c.display_name = t.display_name)", True),
)
def _(r):
    out = select.with_pins(_chosen(r), select.always_run(r["test"], PINS))
    return out.select("assembly", "display_name", (F.size("chain") == 0).alias("pinned"))


_KEYED = "+keyed AS (SELECT DISTINCT type, type || '::' || name || '/' || CAST(params AS STRING) AS member_key, name FROM member)"


@query(
    "provider_consumers",
    duck(
        ["member", "provider_ref"],
        _KEYED + ", hit AS (SELECT r.type, r.member, k.member_key, r.test_key FROM provider_ref r JOIN keyed k ON k.type = r.type AND (r.member = '*' OR r.member = k.name)) SELECT DISTINCT member_key AS provider_key, test_key FROM hit UNION SELECT k.member_key, r.test_key FROM provider_ref r JOIN keyed k ON k.type = r.type WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.type = r.type AND h.member = r.member AND h.test_key = r.test_key)",
    ),
)
def _(r):
    return graph.provider_links(r["provider_ref"], graph.type_members(r["member"]))


# -- graph -----------------------------------------------------------------------------------

_TYPES = ["type", "member", "interface"]
_POLY = """+walk(type, base) AS (SELECT type, base FROM type WHERE base <> '' AND type <> base UNION SELECT w.type, t.base FROM walk w JOIN type t ON t.type = w.base WHERE t.base <> ''),
up AS (SELECT DISTINCT type, base FROM walk WHERE type <> base AND base IN (SELECT type FROM type)),
m AS (SELECT DISTINCT type, name, params, type || '::' || name || '/' || CAST(params AS STRING) AS key, is_virtual FROM member),
direct AS (SELECT u.type, i.interface FROM (SELECT type, base FROM up UNION SELECT type, type FROM type) u JOIN interface i ON i.type = u.base),
face AS (SELECT * FROM direct UNION SELECT d.type, i.interface FROM direct d JOIN interface i ON i.type = d.interface),
poly AS (SELECT a.key AS callee, b.key AS caller FROM m a JOIN face f ON f.type = a.type JOIN m b ON b.type = f.interface AND b.name = a.name AND b.params = a.params WHERE a.is_virtual
  UNION SELECT a.key, b.key FROM m a JOIN up u ON u.type = a.type JOIN m b ON b.type = u.base AND b.name = a.name AND b.params = a.params AND b.is_virtual WHERE a.is_virtual)"""


def _poly(r: Relations) -> DataFrame:
    none = r["interface"].where("false").select(F.col("type").alias("member_key"), F.col("interface").alias("overridden_key"))
    return graph.polymorphism_edges(r["type"], r["member"], r["interface"], none)


@query("polymorphism_edges", duck(_TYPES, _POLY + " SELECT callee, caller FROM poly", True))
def _(r):
    return _poly(r).select("callee", "caller").distinct()


_HOOKED = "hooked AS (SELECT DISTINCT k.member_key, h.method_key FROM keyed k JOIN fixture f ON f.fixture = k.type JOIN hook h ON h.declaring_type = f.type UNION SELECT 'TN:' || f.fixture, h.method_key FROM fixture f JOIN hook h ON h.declaring_type = f.type)"
_FIXTURES = "fixture AS (SELECT interface AS type, type AS fixture FROM interface), hook AS (SELECT type || '::' || name || '/' || CAST(params AS STRING) AS method_key, type AS declaring_type FROM member WHERE name = 'M1')"


def _fixture_edges(r: Relations) -> DataFrame:
    m = r["member"]
    hooks = m.where("name = 'M1'").select(S.method_key(F.col("type"), F.col("name"), F.col("params")).alias("method_key"), F.col("type").alias("declaring_type"))
    return graph.fixture_edges(r["interface"].select(F.col("interface").alias("type"), F.col("type").alias("fixture")), m, hooks)


@query("fixture_edges", duck(_TYPES, f"{_KEYED}, {_FIXTURES}, {_HOOKED} SELECT member_key AS callee, method_key AS caller FROM hooked"))
def _(r):
    return _fixture_edges(r).select("callee", "caller").distinct()


@query("edge_merge", duck(_TYPES, f"{_POLY}, {_KEYED[1:]}, {_FIXTURES}, {_HOOKED} SELECT callee, caller FROM poly WHERE callee <> caller UNION SELECT member_key, method_key FROM hooked WHERE member_key <> method_key", True))
def _(r):
    return graph.merged([_poly(r), _fixture_edges(r)]).select("callee", "caller")


@query("frameworks_present", duck(["ref"], "SELECT DISTINCT name AS assembly, f AS framework FROM ref JOIN (VALUES ('x10', 'ten'), ('X17', 'seventeen'), ('x20', 'twenty')) v(m, f) ON lower(ref) = lower(m)"))
def _(r):
    markers = r.spark.createDataFrame([("x10", "ten"), ("X17", "seventeen"), ("x20", "twenty")], "marker string, framework string")
    return graph.frameworks_present(r["ref"], markers)


_CALLERS = "caller AS (SELECT DISTINCT fqn, type || '::' || name || '/' || CAST(params AS STRING) AS key, type AS user_type FROM member)"


def _callers(r: Relations) -> DataFrame:
    m = r["member"]
    return m.select("assembly", "fqn", S.method_key(F.col("type"), F.col("name"), F.col("params")).alias("key"), F.col("type").alias("user_type")).distinct()


@query("member_type_edges", duck(["member"], f"+{_CALLERS} SELECT DISTINCT key AS callee, 'TN:' || user_type AS caller, 'member' AS kind FROM caller"))
def _(r):
    return graph.member_edges(_callers(r))


@query(
    "body_edges",
    duck(
        ["member", "code"],
        f"""+{_CALLERS}, c AS (SELECT code.*, key FROM code JOIN caller USING (fqn)),
e AS (SELECT target_type || '::' || target_name || '/' || CAST(target_params AS STRING) AS callee, key AS caller, 'call' AS kind FROM c WHERE operand_kind = 'm' AND lower(target_scope) = 'a'
  UNION ALL SELECT 'TN:' || target_type, key, 'field' FROM c WHERE operand_kind = 'f' AND lower(target_scope) = 'a' UNION ALL SELECT 'TN:' || type_arg, key, 'generic' FROM c WHERE operand_kind IN ('m', 'f') AND type_arg IS NOT NULL AND type_arg <> '!0')
SELECT callee, caller, kind, count(*) AS n FROM e GROUP BY ALL""",
    ),
)
def _(r):
    code = r["code"].withColumn("type_args", F.when(F.col("type_arg").isNotNull(), F.array("type_arg")).otherwise(F.array().cast("array<string>")))
    scope = r.spark.createDataFrame([("A",)], "name string")
    return graph.body_edges(code, _callers(r), scope).groupBy("callee", "caller", "kind").agg(F.count("*").alias("n"))


@query(
    "user_types",
    duck(
        ["nested"],
        "+up(type, over, depth) AS (SELECT type, declaring_type, 1 FROM nested WHERE declaring_type IS NOT NULL UNION ALL SELECT u.type, n.declaring_type, u.depth + 1 FROM up u JOIN nested n ON n.type = u.over WHERE n.declaring_type IS NOT NULL AND u.depth < 16), near AS (SELECT u.type, u.over, row_number() OVER (PARTITION BY u.type ORDER BY u.depth) AS k FROM up u JOIN nested o ON o.type = u.over JOIN nested t ON t.type = u.type WHERE NOT starts_with(o.simple_name, '<') AND starts_with(t.simple_name, '<')) SELECT type, type AS user_type FROM nested WHERE NOT starts_with(simple_name, '<') UNION ALL SELECT type, over FROM near WHERE k = 1",
        True,
    ),
)
def _(r):
    return graph.user_types(r["nested"])


@query(
    "type_texts",
    duck(
        ["nested", "interface", "field"],
        """+face AS (SELECT type, string_agg('iface|' || interface || chr(10), '' ORDER BY interface) AS faces FROM interface GROUP BY type),
f AS (SELECT type, string_agg('field|' || name || '|' || field_type || '|fl:' || printf('%X', flags) || coalesce('|const:' || constant, '') || chr(10), '' ORDER BY name) AS fields FROM field GROUP BY type)
SELECT n.type, upper(substr(sha256('type|' || n.type || '|fl:' || printf('%X', (n.flags + 4294967296) % 4294967296) || '|ga:' || CAST(arity AS STRING) || '|base:' || CASE WHEN base = '' THEN '-' ELSE base END || chr(10) || coalesce(faces, '') || coalesce(fields, '')), 1, 32)) AS hash FROM nested n LEFT JOIN face USING (type) LEFT JOIN f USING (type)""",
    ),
)
def _(r):
    faces = r["interface"].withColumn("assembly", F.lit("A"))
    none = r.spark.createDataFrame([], schemas.ATTRIBUTE_FACT)
    return canon.type_texts(r["nested"], faces, r["field"], none).select("type", S.short_hash(F.col("text")).alias("hash"))


_SEEDS = (
    _METHODS
    + f""", {_KEYED[1:]}, named AS (SELECT *, CASE WHEN fqn LIKE '%::<type>' THEN 'TN:' || split_part(fqn, '::', 1) ELSE regexp_extract(fqn, '^(?:[^ ]* )*([^ ]*)::', 1) || '::' || regexp_extract(fqn, '::([^(]*)', 1) || '/' || CAST({{count}} AS STRING) END AS node FROM changes),
t AS (SELECT DISTINCT CASE WHEN starts_with(node, 'TN:') THEN substr(node, 4) WHEN kind = 'removed' THEN split_part(node, '::', 1) END AS type FROM named),
seeded AS (SELECT node, CAST(NULL AS STRING) AS type FROM named WHERE NOT starts_with(node, 'TN:') UNION SELECT 'TN:' || type, type FROM t WHERE type IS NOT NULL UNION SELECT k.member_key, t.type FROM t JOIN keyed k ON k.type = t.type)"""
)


# -- scalars ---------------------------------------------------------------------------------


def _glob_sql(g: str) -> str:
    return f"regexp_matches(replace(url, '\\', '/'), '{S.re2_glob(g)}')"


@query("glob_filter", duck(["path"], f"SELECT page_id, url FROM path WHERE {' OR '.join(_glob_sql(g) for g in GLOBS)}"))
def _(r):
    hit = F.lit(False)
    for g in GLOBS:
        hit = hit | S.glob_match(F.col("url"), g)
    return r["path"].where(hit)


@query("glob_first_match", duck(["path"], f"+m AS (SELECT page_id, url, CASE {' '.join(f'WHEN {_glob_sql(g)} THEN ' + repr(g) for g in GLOBS)} END AS g FROM path) SELECT url AS path, g AS \"glob\" FROM m WHERE g IS NOT NULL ORDER BY page_id LIMIT 1"))
def _(r):
    from .analyze import matching_glob

    hit = matching_glob(r["path"].select(F.col("url").alias("path"), F.col("page_id").alias("order")), GLOBS)
    return r.spark.createDataFrame([hit] if hit else [], "path string, glob string")


@query("scope_filter", duck(["assembly_cur"], "SELECT name, NOT regexp_matches(name, '(?i)^A1[^/]*$') AND regexp_matches(name, '(?i)^a[^/]*$') AS listed, NOT regexp_matches(name, '(?i)^A1[^/]*$') AND methods_analyzed AS adjacent FROM assembly_cur"))
def _(r):
    a = r["assembly_cur"]
    return a.select("name", S.in_scope(F.col("name"), F.col("methods_analyzed"), ["a*"], ["A1*"]).alias("listed"), S.in_scope(F.col("name"), F.col("methods_analyzed"), [], ["A1*"]).alias("adjacent"))


def _normal(x: str) -> str:
    for a, b in ((r"(>b__)[0-9]+_", r"\1#_"), (r"(>d__)[0-9]+", r"\1#"), (r"(c__DisplayClass)[0-9]+_", r"\1#_"), (r"(<>9__)[0-9]+_", r"\1#_"), (r"(g__[A-Za-z0-9_]{1,200}\|)[0-9]+_", r"\1#_")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


@query("normalize_names", duck(["name"], f"SELECT k, {_normal('name')} AS name FROM name"))
def _(r):
    return r["name"].select("k", S.normalize_ordinals(F.col("name")).alias("name"))


@query("owner_extract", duck(["name"], "SELECT k, nullif(regexp_extract(name, '^<([^>]+)>[bg]__', 1), '') AS of_member, nullif(regexp_extract(name, '^<([^>]+)>d__[0-9]+', 1), '') AS of_type, starts_with(name, '<') AS generated FROM name"))
def _(r):
    n = F.col("name")
    return r["name"].select("k", S.owner_of_member(n).alias("of_member"), S.owner_of_type(n).alias("of_type"), S.is_generated(n).alias("generated"))


_ARGS = "regexp_extract(fqn, '\\((.*)\\)$', 1)"
_COUNT = f"CASE WHEN {_ARGS} = '' THEN 0 ELSE 1 + len(list_filter(range(1, length({_ARGS}) + 1), lambda i: substr({_ARGS}, i, 1) = ',' AND length(regexp_replace(substr({_ARGS}, 1, i), '[^<\\[]', '', 'g')) = length(regexp_replace(substr({_ARGS}, 1, i), '[^>\\]]', '', 'g')))) END"


@query("key_parse", duck(["method_cur"], f"SELECT token, CASE WHEN fqn LIKE '%::<type>' THEN 'TN:' || split_part(fqn, '::', 1) ELSE regexp_extract(fqn, '^(?:[^ ]* )*([^ ]*)::', 1) || '::' || regexp_extract(fqn, '::([^(]*)', 1) || '/' || CAST({_COUNT} AS STRING) END AS key FROM method_cur"))
def _(r):
    return r["method_cur"].select("token", S.key_of_fqn(F.col("fqn")).alias("key"))


@query("param_count", duck(["method_cur"], f"SELECT token, {_COUNT} AS n FROM method_cur"))
def _(r):
    return r["method_cur"].select("token", S.param_count(F.regexp_extract("fqn", r"\((.*)\)$", 1)).alias("n"))


@query("member_name", duck(["member"], _KEYED + " SELECT member_key, regexp_extract(member_key, '::(.*)/[^/]*$', 1) AS name FROM keyed"))
def _(r):
    return graph.type_members(r["member"]).select("member_key", S.member_name(F.col("member_key")).alias("name"))


@query("type_seeds", duck([*_SNAP, "member"], _SEEDS.format(count=_COUNT) + " SELECT node, type FROM seeded"))
def _(r):
    return select.seeds(_changes(r), graph.type_members(r["member"]))


_HIT_TYPES = ["test", "base_type", "seed"]


@query("type_change_hits", duck(_HIT_TYPES, f"+{_BELOW}, changed AS (SELECT DISTINCT base AS type FROM base_type WHERE CAST(substr(base, 3) AS INT) % 50 = 7) SELECT DISTINCT t.display_name, t.assembly FROM changed c JOIN below b ON b.base = c.type JOIN test t ON t.declaring_type = b.type", True))
def _(r):
    changed = r["base_type"].where("CAST(substr(base, 3) AS INT) % 50 = 7").select(F.concat(F.lit("TN:"), F.col("base")).alias("node"), F.col("base").alias("type")).distinct()
    return select.type_hits(changed, r["test"], select.descendants(r["base_type"], changed)).select("display_name", "assembly").distinct()


_LINKS = "hit AS (SELECT r.type, r.member, k.member_key, r.test_key FROM provider_ref r JOIN keyed k ON k.type = r.type AND (r.member = '*' OR r.member = k.name)), link AS (SELECT member_key AS provider_key, test_key FROM hit UNION SELECT k.member_key, r.test_key FROM provider_ref r JOIN keyed k ON k.type = r.type WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.type = r.type AND h.member = r.member AND h.test_key = r.test_key))"


@query("provider_change_hits", duck(["test", "member", "provider_ref"], f"{_KEYED}, {_LINKS} SELECT DISTINCT t.display_name, t.assembly FROM keyed k JOIN link l ON l.provider_key = k.member_key JOIN test t ON t.key = l.test_key WHERE k.name = 'M2'"))
def _(r):
    own = graph.type_members(r["member"])
    changed = own.where(S.member_name(F.col("member_key")) == "M2").select(F.col("member_key").alias("node"), F.lit(None).cast("string").alias("type"))
    return select.provider_hits(changed, r["test"], graph.provider_links(r["provider_ref"], own)).select("display_name", "assembly").distinct()


# -- changed ranges --------------------------------------------------------------------------

_LIST = """+t AS (SELECT trim(line) AS x FROM listed), p AS (SELECT x, regexp_extract(x, '^(.*):([0-9]+)(-([0-9]+))?$', 1) AS path, try_cast(regexp_extract(x, '^(.*):([0-9]+)(-([0-9]+))?$', 2) AS INT) AS a,
  try_cast(coalesce(nullif(regexp_extract(x, '^(.*):([0-9]+)(-([0-9]+))?$', 4), ''), regexp_extract(x, '^(.*):([0-9]+)(-([0-9]+))?$', 2)) AS INT) AS b FROM t WHERE x <> '' AND NOT starts_with(x, '#'))
SELECT CASE WHEN a > 0 AND b >= a THEN path ELSE x END AS path, CASE WHEN a > 0 AND b >= a THEN a ELSE 1 END AS start_line, CASE WHEN a > 0 AND b >= a THEN b ELSE 2147483647 END AS end_line FROM p"""


@query("parse_changed_list", duck(["listed"], _LIST))
def _(r):
    return changes.parse_list(r["listed"])


@query(
    "parse_unified_diff",
    duck(
        ["hunk"],
        r"""+f AS (SELECT *, last_value(CASE WHEN starts_with(line, '+++ ') THEN split_part(substr(line, 5), chr(9), 1) END IGNORE NULLS) OVER (PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM hunk WHERE regexp_matches(line, '^(\+\+\+ |--- |@@ )')),
h AS (SELECT path, CAST(regexp_extract(line, '\+([0-9]+)', 1) AS INT) AS a, CAST(coalesce(nullif(regexp_extract(line, '\+[0-9]+,([0-9]+)', 1), ''), '1') AS INT) AS d FROM f WHERE starts_with(line, '@@ ') AND path IS NOT NULL AND path <> '/dev/null')
SELECT path, greatest(a, 1) AS start_line, CASE WHEN d > 0 THEN a + d - 1 ELSE greatest(a, 1) END AS end_line FROM h""",
    ),
)
def _(r):
    return changes.parse_diff(r["hunk"])


_SPANS = "+s AS (SELECT assembly, method_fqn AS fqn, document, min(start_line) AS first_line, max(end_line) AS last_line FROM point WHERE NOT hidden GROUP BY ALL)"
_FITS = "(lower(document) = lower(path) OR ends_with(lower(document), '/' || lower(path)) OR (contains(path, '/') AND (lower(document) = lower(substr(path, strpos(path, '/') + 1)) OR ends_with(lower(document), '/' || lower(substr(path, strpos(path, '/') + 1))))))"
_BASE = "regexp_extract(lower({}), '[^/]*$') "


@query("method_spans", duck(["point"], _SPANS + " SELECT * FROM s"))
def _(r):
    return ranges.spans(r["point"])


@query("range_overlap", duck(["point", "range"], f"{_SPANS} SELECT assembly, fqn, document, path, start_line, end_line FROM s JOIN range ON {_BASE.format('document')} = {_BASE.format('path')} AND {_FITS} AND first_line <= end_line AND last_line >= start_line"))
def _(r):
    return ranges.overlapping(ranges.spans(r["point"]), r["range"])


@query("suffix_match", duck(["point", "range"], f"SELECT DISTINCT document, path FROM (SELECT DISTINCT document FROM point) JOIN (SELECT DISTINCT path FROM range) ON {_BASE.format('document')} = {_BASE.format('path')} AND {_FITS}"))
def _(r):
    return ranges.fitting(r["point"].select("document").distinct(), r["range"].select("path").distinct()).select("document", "path")


@query("unmatched_paths", duck(["point", "range"], f"SELECT path FROM (SELECT DISTINCT path FROM range) r WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT document FROM point) WHERE {_BASE.format('document')} = {_BASE.format('path')} AND {_FITS})"))
def _(r):
    return ranges.unmatched(r["point"], r["range"])


# -- canonical text --------------------------------------------------------------------------


@query(
    "canonical_hash",
    duck(
        ["instruction"],
        """+n AS (SELECT *, sum(CASE WHEN opcode <> 'nop' THEN 1 ELSE 0 END) OVER (PARTITION BY fqn ORDER BY place) - CASE WHEN opcode <> 'nop' THEN 1 ELSE 0 END AS before, sum(CASE WHEN opcode <> 'nop' THEN 1 ELSE 0 END) OVER (PARTITION BY fqn) AS total FROM instruction),
p AS (SELECT fqn, place, CASE WHEN before < total THEN before ELSE -1 END AS ordinal FROM n),
l AS (SELECT n.fqn, n.place, n.opcode || ' ' || CASE n.operand_kind WHEN 'm' THEN 'm:' || operand WHEN 's' THEN 's:' || operand WHEN '@' THEN '@' || CAST(coalesce(p.ordinal, -1) AS STRING) ELSE '' END || chr(10) AS line FROM n LEFT JOIN p ON p.fqn = n.fqn AND p.place = n.target WHERE opcode <> 'nop')
SELECT fqn, upper(substr(sha256(string_agg(line, '' ORDER BY place)), 1, 32)) AS hash FROM l GROUP BY fqn""",
    ),
)
def _(r):
    code = r["instruction"].withColumnRenamed("place", "offset").withColumn("jumps", F.when(F.col("operand_kind") == "@", F.array("target")))
    return canon.instruction_lines(code).select("fqn", S.short_hash(F.col("lines")).alias("hash"))


@query(
    "canonical_contrib",
    duck(
        ["member"],
        """+own AS (SELECT type, name, fqn, 'text' || fqn AS text, params AS token FROM member WHERE params < 2), part AS (SELECT type, name AS owner, 'g' || fqn AS fqn, upper(substr(sha256(fqn), 1, 32)) AS hash FROM member WHERE params = 2),
added AS (SELECT type, owner, string_agg(chr(10) || 'contrib|' || fqn || '|' || hash, '' ORDER BY fqn || '|' || hash) AS more FROM part GROUP BY type, owner)
SELECT fqn, upper(substr(sha256(text || coalesce(more, '')), 1, 32)) AS hash, token FROM own LEFT JOIN added a ON a.type = own.type AND a.owner = own.name
UNION ALL SELECT fqn, min(hash), 0 FROM part p WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.type = p.type AND own.name = p.owner) GROUP BY fqn""",
    ),
)
def _(r):
    m = r["member"]
    own = m.where("params < 2").select("assembly", "type", "name", "fqn", F.concat(F.lit("text"), F.col("fqn")).alias("text"), F.col("params").alias("token"))
    part = m.where("params = 2").select("assembly", "type", F.col("name").alias("owner"), F.concat(F.lit("g"), F.col("fqn")).alias("fqn"), S.short_hash(F.col("fqn")).alias("hash"))
    return canon.contributions(own, part).drop("assembly")


# -- filters ---------------------------------------------------------------------------------

_ESCAPED = r"regexp_replace(display_name, '([\\()&|=!~])', '\\\1', 'g')"



@query("vstest_filters", duck(["test"], f"SELECT assembly, count(*) AS test_count, CASE WHEN count(*) > {emit.MAX_CLAUSES} THEN '' ELSE string_agg('FullyQualifiedName' || CASE WHEN parameterized THEN '~' ELSE '=' END || {_ESCAPED}, '|' ORDER BY display_name) END AS filter FROM test GROUP BY assembly"))
def _(r):
    return emit.filters(r["test"], "VsTest").select("assembly", "test_count", "filter")


@query(
    "treenode_filters",
    duck(["test"], f"SELECT assembly, count(*) AS test_count, CASE WHEN count(*) > {emit.MAX_CLAUSES} THEN '' ELSE '/' || assembly || '/*/(' || string_agg(DISTINCT class_name, '|' ORDER BY class_name) || ')/(' || string_agg(DISTINCT display_name || CASE WHEN parameterized THEN '*' ELSE '' END, '|' ORDER BY display_name || CASE WHEN parameterized THEN '*' ELSE '' END) || ')' END AS filter FROM test GROUP BY assembly"),
)
def _(r):
    return emit.filters(r["test"], "TreeNode").select("assembly", "test_count", "filter")


@query("filter_threshold", duck(["test"], f"SELECT assembly, count(*) AS test_count, count(*) > 60 AS run_whole_assembly, CASE WHEN count(*) > 60 THEN '' ELSE string_agg('FullyQualifiedName' || CASE WHEN parameterized THEN '~' ELSE '=' END || {_ESCAPED}, '|' ORDER BY display_name) END AS filter FROM test GROUP BY assembly"))
def _(r):
    return emit.filters(r["test"], "VsTest", max_clauses=60).select("assembly", "test_count", "run_whole_assembly", "filter")


@query("filter_lines", duck(["test", "nation"], f"SELECT assembly, coalesce(CASE WHEN substr(assembly, 2) IN ('1', '2', '3') THEN '/out/n' || substr(assembly, 2) || '.dll' END, assembly) || chr(9) || 'VsTest' || chr(9) || CASE WHEN count(*) > 60 THEN '' ELSE string_agg('FullyQualifiedName' || CASE WHEN parameterized THEN '~' ELSE '=' END || {_ESCAPED}, '|' ORDER BY display_name) END AS line FROM test GROUP BY assembly"))
def _(r):
    dlls = r["nation"].where("n_nationkey in (1, 2, 3)").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.concat(F.lit("/out/n"), F.col("n_nationkey").cast("string"), F.lit(".dll")).alias("dll"))
    return emit.filter_lines(emit.filters(r["test"], "VsTest", dlls, 60))


@query("run_settings", duck(["test"], f"SELECT assembly, length(CASE WHEN count(*) > 60 THEN '' ELSE replace(string_agg('FullyQualifiedName' || CASE WHEN parameterized THEN '~' ELSE '=' END || {_ESCAPED}, '|' ORDER BY display_name), '&', '&amp;') END) AS n FROM test GROUP BY assembly"))
def _(r):
    out = emit.run_settings(emit.filters(r["test"], "VsTest", max_clauses=60))
    return out.select("assembly", F.length(F.regexp_extract("content", "(?s)<TestCaseFilter>(.*)</TestCaseFilter>", 1)).alias("n"))


@query("explain_chains", duck(_SELECT, _FIRST + """ SELECT display_name, CASE WHEN len(r.chain) > 1 THEN array_to_string(r.chain, chr(10) || '        -> ') END AS via FROM chosen c JOIN reached r ON r.node = c.node""", True))
def _(r):
    return emit.explained(_chosen(r)).select("display_name", "via")


# -- frameworks of projects ------------------------------------------------------------------

_PAIR = "+pair AS (SELECT DISTINCT project, regexp_extract(directory, '[^/]*$') AS tfm FROM candidate), c AS (SELECT tfm, count(*) AS n FROM pair GROUP BY tfm), t AS (SELECT count(DISTINCT project) AS total FROM pair)"


@query("common_tfm", duck(["candidate"], _PAIR + " SELECT tfm, n = total AS common FROM c, t ORDER BY n = total DESC, CASE WHEN n = total THEN 0 ELSE -n END, lower(tfm), tfm LIMIT 1"))
def _(r):
    return solution.choose_tfm(r["candidate"])


@query("mode_tfm", duck(["candidate"], _PAIR.replace("FROM candidate", "FROM candidate WHERE NOT (directory LIKE '%net6.0' AND project LIKE '%7')") + " SELECT tfm, n = total AS common FROM c, t ORDER BY n = total DESC, CASE WHEN n = total THEN 0 ELSE -n END, lower(tfm), tfm LIMIT 1"))
def _(r):
    return solution.choose_tfm(r["candidate"].where("not (directory like '%net6.0' and project like '%7')"))


@query("dominant_tfm", duck(["tfm_attribute"], """SELECT coalesce(max_by(tfm, key), '') AS tfm FROM (SELECT tfm, {'v': list_transform(string_split(regexp_extract(tfm, 'Version=v?([0-9.]+)', 1), '.'), lambda x: CAST(x AS INT)), 'o': -"order"} AS key FROM tfm_attribute WHERE starts_with(tfm, '.NETCoreApp'))"""))
def _(r):
    return solution.dominant_tfm(r["tfm_attribute"])


# -- cache keys and decisions ----------------------------------------------------------------


@query("cache_key", duck(["assembly_cur"], "SELECT upper(substr(sha256('1' || chr(10) || 'scope' || chr(10) || 'nunit' || chr(10) || string_agg(lower(name) || ':' || content_hash, chr(10) ORDER BY lower(name) || ':' || content_hash)), 1, 32)) AS key FROM assembly_cur WHERE methods_analyzed"))
def _(r):
    return cache.whole_key(r["assembly_cur"].withColumn("mvid", F.col("content_hash")), "scope", "NUnit")


@query(
    "part_cache_keys",
    duck(
        ["ref"],
        "+low AS (SELECT DISTINCT lower(name) AS name, lower(ref) AS ref FROM ref), walk(name, ref) AS (SELECT name, ref FROM low UNION SELECT w.name, l.ref FROM walk w JOIN low l ON l.name = w.ref), nodes AS (SELECT DISTINCT name FROM (SELECT name FROM low UNION SELECT ref FROM low)), every AS (SELECT name, name AS ref FROM nodes UNION SELECT name, ref FROM walk) SELECT name, upper(substr(sha256('1' || chr(10) || 's' || chr(10) || 'xunit' || chr(10) || name || chr(10) || string_agg(ref || ':' || 'v' || ref, chr(10) ORDER BY ref || ':' || 'v' || ref)), 1, 32)) AS key FROM every GROUP BY name",
        True,
    ),
)
def _(r):
    names = r["ref"].select(F.lower("name").alias("name")).union(r["ref"].select(F.lower("ref"))).distinct()
    return cache.part_keys(names.withColumn("mvid", F.concat(F.lit("v"), F.col("name"))), reach.reference_closure(r["ref"]), "s", "xunit")


_FLAGS = "SELECT o_orderkey AS case_id, o_orderkey % 13 = 0 AS forced, o_orderkey % 11 <> 0 AS has_baseline, o_orderkey % 2 = 0 AS has_ranges, o_orderkey % 17 = 0 AS tfm_differs, o_orderkey % 19 = 0 AS scope_differs, o_orderkey % 23 = 0 AS content_changed, o_orderkey % 3 AS n_added, o_orderkey % 4 AS n_changed, o_orderkey % 29 AS r, o_orderkey % 7 AS u, o_orderkey % 5 AS n_changes, o_orderkey % 9 AS n_tests FROM {orders}"


@query(
    "decision_ladder",
    "WITH f AS (" + _FLAGS.format(orders="orders") + "), g AS (SELECT *, CASE WHEN r = 3 THEN 1 ELSE 0 END AS n_removed, CASE WHEN u = 2 THEN 1 ELSE 0 END AS n_untraceable FROM f) SELECT case_id, CASE WHEN forced THEN '0' WHEN NOT has_baseline AND NOT has_ranges THEN '1' WHEN NOT has_baseline THEN 'L' WHEN tfm_differs THEN '2' WHEN scope_differs THEN '3' WHEN content_changed THEN '4' WHEN n_added + n_changed + n_removed = 0 THEN '5' WHEN n_removed > 0 THEN '6' WHEN n_untraceable > 0 THEN '7' WHEN n_changes = 0 THEN '8' WHEN n_tests = 0 THEN '9' ELSE '10' END AS rule FROM g",
)
def _(r):
    flags = r.spark.sql(_FLAGS, orders=r["orders"])
    flags = flags.withColumns({"n_removed": (F.col("r") == 3).cast("int"), "n_untraceable": (F.col("u") == 2).cast("int")})
    return flags.select("case_id", ladder_column().alias("rule"))


@query("attribute_rules", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'NUnit.Framework.TestAttribute' WHEN 1 THEN 'My.Fast' ELSE 'My.Slow' END AS attribute, 'test' AS role FROM orders WHERE o_orderkey % 4 < 3")
def _(r):
    name = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'NUnit.Framework.TestAttribute' WHEN 1 THEN 'My.Fast' WHEN 2 THEN 'My.Slow' ELSE 'My.Other' END")
    facts = r["orders"].select(F.col("o_orderkey").alias("k"), name.alias("attribute"))
    bases = r.spark.createDataFrame([("My.Fast", "My.Slow"), ("My.Slow", "NUnit.Framework.TheoryAttribute"), ("My.Other", "System.Attribute")], "attribute string, base string")
    hit = rules.matched(facts, bases, rules.rule_table(r.spark, "nunit").where("role = 'test'"))
    return hit.select("k", "attribute", "role")


