"""From changes to a verdict: run everything, nothing, or a selection.

The rules stand in an order that is part of their meaning. Each looks at a small aggregate, so
the ladder stays on the driver and the graph is not planned where an early rule decides.
Whatever cannot be traced leads to running everything, never to an empty selection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import first_few, glob_regex, slashed
from ..operators import diff, emit, graph, ranges, reach, rules, select
from ..storage import stored

#: Changed paths that always call for a full run, unless the caller names others (fixed values).
FORCE_FULL_RUN = ["**/appsettings*.json", "**/Migrations/**", "**/*.razor", "**/*.cshtml"]
DEGRADED = "by line map only: changes of generated code, packages and analysers are not seen, moved code may be given to the wrong member"


@dataclass
class Snapshot:
    """A build: header and relations. Facts are needed of the current build alone."""

    tfm: str
    scope: str
    assembly: DataFrame
    method: DataFrame
    content_file: DataFrame
    version: int = schemas.VERSION


@dataclass
class Graph:
    """What selection needs of a build's graph."""

    edges: DataFrame
    tests: DataFrame
    lifecycle: DataFrame
    below: DataFrame
    type_members: DataFrame
    provider_links: DataFrame
    frameworks: DataFrame


@dataclass
class Result:
    run_everything: bool
    reason: str
    selection: DataFrame | None = None
    assemblies: DataFrame | None = None
    changes: DataFrame | None = None
    front_end: str | None = None
    warnings: list[str] = field(default_factory=list)
    rule: str = ""

    @staticmethod
    def everything(rule: str, reason: str, **more) -> "Result":
        return Result(True, reason, rule=rule, **more)


def matching_glob(paths: DataFrame, globs: list[str]) -> tuple[str, str] | None:
    """The first changed path (columns path, order) that a glob matches, and the first such glob."""
    first = F.lit(None).cast("string")
    for g in reversed(globs):
        first = F.when(slashed(F.col("path")).rlike(glob_regex(g)), F.lit(g)).otherwise(first)
    hit = paths.withColumn("glob", first).where("glob is not null")
    row = hit.agg(F.min_by(F.struct("path", "glob"), F.struct("order", "path")).alias("b")).first()["b"]
    return (row["path"], row["glob"]) if row else None


def _names(df: DataFrame, column: str = "name") -> list[str]:
    """Names for a message: the first six in order, which is what first_few() shows and more."""
    return [r[0] for r in df.select(column).orderBy(column).limit(6).collect()]


def _few(df: DataFrame, total: int) -> str:
    shown = _names(df)[:5]
    return first_few(shown) + (f" +{total - 5} more" if total > 5 else "")


def _select(g: Graph, changes: DataFrame) -> DataFrame:
    seeded = stored(select.seeds(changes, g.type_members))
    reached = reach.reach(g.edges, seeded.select("node"), written=True)
    return stored(select.select_tests(reached, seeded, g.tests, g.lifecycle, g.below, g.provider_links))


def no_tests(g: Graph, framework: str) -> str | None:
    """Why a build without tests of the framework cannot be selected from; None if it has some."""
    if g.tests.limit(1).count():
        return None
    others = sorted({r[0] for r in g.frameworks.select("framework").distinct().collect()} - {framework.lower()})  # a handful of frameworks
    if others:
        return f"code changed, but there are no {framework} tests; the build refers to {' and '.join(others)}, so --test-framework {others[0]} may be meant"
    return f"code changed, but there are no {framework} tests in the analysed assemblies; does the scope include the test projects?"


def _other_frameworks(g: Graph, framework: str) -> list[str]:
    names = sorted({r[0] for r in g.frameworks.select("framework").distinct().collect()} - {framework.lower()})
    return [f"the build also has {n} tests, which this run does not cover; --test-framework {n} selects those" for n in names]


def analyze(
    spark: SparkSession,
    baseline: Snapshot | None,
    current: Snapshot,
    build_graph,
    framework: str,
    changed: DataFrame | None = None,
    globs: list[str] | None = None,
    points: DataFrame | None = None,
    types: DataFrame | None = None,
    members: DataFrame | None = None,
    pins: list[str] | None = None,
) -> Result:
    """The verdict. build_graph() is called only when a selection is due. Any failure in here
    becomes a verdict to run everything."""
    try:
        out = _ladder(spark, baseline, current, build_graph, framework, changed, globs, points, types, members)
    except Exception as e:  # noqa: BLE001  fail open: an error must never narrow a run
        return Result.everything("X", f"analysis failed: {type(e).__name__}: {str(e)[:300]}")
    if pins and not out.run_everything and out.selection is not None:
        out.selection = select.with_pins(out.selection, select.always_run(build_graph().tests, pins))
    return out


def _ladder(spark, baseline, current, build_graph, framework, changed, globs, points, types, members) -> Result:
    have = changed is not None and bool(changed.limit(1).count())
    if have:
        numbered = changed.withColumn("order", F.monotonically_increasing_id()) if "order" not in changed.columns else changed
        if hit := matching_glob(numbered, globs or FORCE_FULL_RUN):
            return Result.everything("0", f"changed file {hit[0]} matches {hit[1]}, which calls for a full run")
    if baseline is None:
        if not have:
            return Result.everything("1", "there is neither a baseline nor a list of changed files")
        return _by_lines(current, build_graph, framework, changed, points, types, members)
    if baseline.tfm != current.tfm:
        return Result.everything("2", f"the baseline's target framework {baseline.tfm} is not the build's {current.tfm}")
    if baseline.scope != current.scope:
        return Result.everything("3", f"the baseline's scope {baseline.scope} is not the build's {current.scope}")
    report = stored(diff.diff_assemblies(baseline.assembly, current.assembly))
    content, old = diff.diff_content(baseline.content_file, current.content_file, baseline.version)
    warnings = ["the baseline is from before content files were recorded; a change of configuration would not be seen"] if old else []
    more = {"assemblies": report, "warnings": warnings, "front_end": "manifest"}
    n = content.count()
    if n:
        return Result.everything("4", f"build outputs that are no assemblies changed ({_few(content, n)}); what they affect cannot be traced", **more)
    counts = {r["status"]: r["count"] for r in report.groupBy("status").count().collect()}
    if not any(counts.get(s) for s in ("added", "changed", "removed")):
        return Result(False, "no assembly changed", rule="5", **more)
    if counts.get("removed"):
        return Result.everything("6", f"assemblies were removed: {_few(report.where('status = ' + repr('removed')), counts['removed'])}", **more)
    opaque = diff.untraceable(report.where("status in ('changed', 'added')").select("name"), current.assembly)
    n = opaque.count()
    if n:
        return Result.everything("7", f"assemblies outside the scope changed and cannot be traced ({_few(opaque, n)})", **more)
    changes = stored(diff.diff_methods(baseline.method, current.method, report))
    more["changes"] = changes
    n = changes.count()
    if not n:
        return Result.everything("8", "an assembly's content changed, but no member that the model knows", **more)
    g = build_graph()
    if why := no_tests(g, framework):
        return Result.everything("9", why, **more)
    chosen = _select(g, changes)
    more["warnings"] = warnings + _other_frameworks(g, framework)
    return Result(False, f"{n} changed member(s), {chosen.count()} impacted test(s)", selection=chosen, rule="10", **more)


def _by_lines(current: Snapshot, build_graph, framework: str, changed: DataFrame, points: DataFrame | None, types: DataFrame, members: DataFrame) -> Result:
    spans = ranges.spans(points) if points is not None else None
    lost = ranges.unmatched(spans, changed) if points is not None else changed.select("path").distinct()
    other = [r[0] for r in lost.where(~F.lower("path").endswith(".cs")).orderBy("path").limit(1).collect()]
    if other:
        return Result.everything("L1", f"{other[0]} belongs to no source document, so what it affects cannot be traced")
    if points is None or not points.limit(1).count():
        return Result.everything("L2", "there are no symbols in the build, so lines cannot be mapped to members")
    warnings = [f"{p} matches no source document" for p in _names(lost, "path")]
    changes = stored(ranges.owners(ranges.overlapping(spans, changed), types, members))
    more = {"changes": changes, "front_end": "pdb", "warnings": warnings}
    n = changes.count()
    if not n:
        return Result(False, f"{DEGRADED}: the changed lines touch no member", rule="L3", **more)
    opaque = diff.untraceable(changes.select(F.col("assembly").alias("name")), current.assembly)
    k = opaque.count()
    if k:
        return Result.everything("L4", f"assemblies outside the scope changed and cannot be traced ({_few(opaque, k)})", **more)
    g = build_graph()
    if why := no_tests(g, framework):
        return Result.everything("L5", why, **more)
    chosen = _select(g, changes)
    more["warnings"] = warnings + _other_frameworks(g, framework)
    return Result(False, f"{DEGRADED}: {n} changed member(s), {chosen.count()} impacted test(s)", selection=chosen, rule="L6", **more)


def graph_of(framework: str, facts: dict[str, DataFrame], scope: DataFrame) -> Graph:
    """The graph of a build's facts (types, members, instructions, attributes, attribute_bases,
    interfaces, overrides, references)."""
    f = facts
    tests, lifecycle, refs, fixtures = (stored(x) for x in rules.classify(framework, f["members"], f["types"], f["attributes"], f["attribute_bases"], f["interfaces"]))
    edges = graph.build(f["types"], f["members"], f["instructions"], f["interfaces"], f["overrides"], scope, lifecycle, fixtures, refs)
    own = graph.type_members(f["members"])
    present = graph.frameworks_present(f["references"], rules.marker_table(tests.sparkSession))
    parts = (edges, tests, lifecycle, select.descendants(graph.base_types(f["types"])), own, graph.provider_links(refs, own), present)
    return Graph(*[stored(x) for x in parts])  # many plans read these


def ladder_column() -> "F.Column":
    """The manifest rules 0 to 10 as one column over a row of flags: the first that holds decides."""
    rows = [
        ("forced", "0"), ("not has_baseline and not has_ranges", "1"), ("not has_baseline", "L"), ("tfm_differs", "2"), ("scope_differs", "3"), ("content_changed", "4"),
        ("n_added + n_changed + n_removed = 0", "5"), ("n_removed > 0", "6"), ("n_untraceable > 0", "7"), ("n_changes = 0", "8"), ("n_tests = 0", "9"),
    ]
    out = F.lit("10")
    for condition, rule in reversed(rows):
        out = F.when(F.expr(condition), rule).otherwise(out)
    return out


def report(result: Result, framework: str, dlls: DataFrame | None = None, max_clauses: int = emit.MAX_CLAUSES, assembly: str | None = None) -> tuple[DataFrame | None, int]:
    """The filters of a verdict (of one assembly, without case, if named) and the exit code."""
    if result.run_everything or result.selection is None:
        return None, emit.exit_code(result.run_everything, 0)
    table = emit.filters(result.selection, rules.DIALECT[framework.lower()], dlls, max_clauses)
    if assembly:
        table = table.where(F.lower("assembly") == assembly.lower())
    return table, emit.exit_code(False, table.count())
