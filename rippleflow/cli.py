"""Command line: snapshot facts into a manifest, analyse a change, print filters.

The commands read a build's facts (Parquet folders named as in schemas, below one directory) and
its file listing; decoding binaries into facts is not part of this package. Three fact tables may
be missing: modules (framework names and version ids; without them neither a build's framework nor
its cache keys are known), bodies (locals and exception regions) and sequence_points.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from dataclasses import fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions.scalars import scope_text
from .operators import canon, diff, emit, rules
from .plans import analyze as A
from .sources import cache, changes, listing, manifest, pe, solution
from .storage import stored

OPTIONAL = {"modules": schemas.MODULE_FACT, "bodies": schemas.BODY_FACT}
FACTS = ("types", "members", "instructions", "attributes", "attribute_bases", "interfaces", "overrides", "fields", "references")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rippleflow")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("snapshot", "analyze"):
        s = sub.add_parser(name)
        source = s.add_mutually_exclusive_group()
        source.add_argument("--solution")
        source.add_argument("--project")
        s.add_argument("--input", "--current", action="append", default=[], help="build output directory")
        s.add_argument("--facts", required=True, help="directory of fact tables")
        s.add_argument("--include", action="append", default=[])
        s.add_argument("--exclude", action="append", default=[])
        s.add_argument("-c", "--configuration", default="Release")
        s.add_argument("-f", "--framework", help="target framework of the build")
    sub.choices["snapshot"].add_argument("-o", "--output", required=True, help="a folder of tables, or (*.json) a JSON manifest")
    sub.choices["snapshot"].add_argument("--previous", help="manifest whose unchanged assemblies need no hashing")
    a = sub.choices["analyze"]
    a.add_argument("--manifest")
    a.add_argument("--baseline", action="append", default=[], help="build output directory to compare with, in place of a manifest")
    a.add_argument("--baseline-facts", help="directory of that build's fact tables")
    a.add_argument("--cache", help="directory that runs share for what follows from a build alone")
    a.add_argument("--changed-files")
    a.add_argument("--format", choices=("json", "filter", "filter-lines", "runsettings"), default="json")
    a.add_argument("--force-full-run-paths", action="append", default=[])
    a.add_argument("--max-filter-clauses", type=int, default=emit.MAX_CLAUSES)
    a.add_argument("--output-dir", default=".")
    a.add_argument("--explain", action="store_true")
    a.add_argument("--always-run", action="append", default=[])
    a.add_argument("--test-framework", required=True, choices=sorted(rules.RULES), type=str.lower)
    a.add_argument("--assembly")
    return p


def inputs(args: argparse.Namespace) -> tuple[list[str], list[str], list[str], list[str]]:
    """Directories, include and exclude globs, and warnings; an explicit scope beats the solution's."""
    source = args.solution or args.project
    if bool(source) == bool(args.input):
        raise ValueError("give either --input or one of --solution and --project")
    if not source:
        return args.input, args.include, args.exclude, []
    found = solution.load(source, args.configuration, args.framework)
    include = args.include if args.include or args.exclude else found.include
    return found.directories, include, args.exclude, found.warnings


def facts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    out = {name: spark.read.parquet(f"{root}/{name}") for name in FACTS}
    for name, schema in OPTIONAL.items():
        try:
            out[name] = spark.read.parquet(f"{root}/{name}")
        except AnalysisException:
            out[name] = spark.createDataFrame([], schema)
    return out


def snapshot(spark: SparkSession, directories: list[str], include: list[str], exclude: list[str], f: dict[str, DataFrame], previous: A.Snapshot | None = None) -> A.Snapshot:
    """The build of some directories: newest copy of each assembly, its content hash, and the hashes
    of members and types in scope.

    Where modules are known, a library without one is native and gets no row. Assemblies whose content
    a previous snapshot has keep its hashes; the others are hashed.
    """
    files = listing.scoped(listing.with_symbols(listing.scan(spark, directories, "*")), include, exclude)
    dlls = listing.newest(files.where(F.lower("file").endswith(".dll"))).withColumn("name", F.regexp_replace("file", r"\.[^.]*$", ""))
    modules = f["modules"]
    known = bool(modules.limit(1).count())
    ids = modules.groupBy(F.lower("assembly").alias("_k")).agg(F.min("mvid").alias("mvid"))
    dlls = dlls.join(ids, F.lower("name") == F.col("_k"), "inner" if known else "left").drop("_k")
    hashed = dlls.join(pe.hashed(dlls), "path")
    one = stored(listing.first_assembly(hashed).select("name", F.coalesce("mvid", F.lit("")).alias("mvid"), "content_hash", "in_scope"))
    assembly = one.select("name", "mvid", "content_hash", F.col("in_scope").alias("methods_analyzed"))
    carried, left = diff.reuse(one, previous.assembly, previous.method) if previous is not None else (None, one.where("in_scope"))
    names = left.select(F.lower("name").alias("_k"), F.col("name").alias("_name"))
    todo = {k: f[k].join(names, F.lower("assembly") == F.col("_k"), "left_semi") for k in ("types", "members", "instructions", "interfaces", "fields", "attributes", "bodies")}
    rows = canon.hash_members(*(todo[k] for k in ("types", "members", "instructions", "interfaces", "fields", "attributes")), todo["bodies"])
    method = rows.join(names, F.lower("assembly") == F.col("_k")).select(F.col("_name").alias("assembly"), "token", "fqn", "hash")
    inside = one.where("in_scope").select(F.lower("name").alias("_k"))
    tfm = solution.dominant_tfm(modules.where("tfm is not null").join(inside, F.lower("assembly") == F.col("_k"), "left_semi")).first()["tfm"]
    return A.Snapshot(tfm, scope_text(include, exclude), assembly, stored(method if carried is None else method.unionByName(carried)), listing.content_files(files))


def cached_graph(spark: SparkSession, root: str | None, current: A.Snapshot, framework: str, build: Callable[[], A.Graph]) -> A.Graph:
    """The build's graph from the cache, else built and cached.

    The key holds the scope, the framework and the version id of every assembly in depth; if one of
    these is not known, or no cache is named, the graph is built.
    """
    deep = current.assembly.where("methods_analyzed")
    if not root or deep.where("coalesce(mvid, '') = ''").limit(1).count():
        return build()
    key = cache.whole_key(current.assembly, current.scope, framework).first()["key"]
    parts = {p.name: cache.load(spark, root, f"{key}-{p.name}") for p in fields(A.Graph)}
    if all(x is not None for x in parts.values()):
        return A.Graph(**parts)
    graph = build()
    cache.prune(spark, root)
    for p in fields(A.Graph):
        cache.save(getattr(graph, p.name), root, f"{key}-{p.name}")
    return graph


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("rippleflow").getOrCreate()
    try:
        directories, include, exclude, warnings = inputs(args)
        f = facts(spark, args.facts)
        previous = _baseline(spark, args.manifest if args.command == "analyze" else args.previous)
        current = snapshot(spark, directories, include, exclude, f, previous)
        if args.command == "analyze" and args.baseline:
            previous = snapshot(spark, args.baseline, include, exclude, facts(spark, args.baseline_facts or args.facts))
        for w in warnings:
            print(f"warning: {w}", file=sys.stderr)
        if args.command == "snapshot":
            parts = (spark, current.tfm, current.scope, current.assembly, current.method, current.content_file)
            if args.output.endswith(".json"):
                manifest.save(manifest.nested(*parts), args.output)
            else:
                manifest.save_relations(*parts, args.output)
            return emit.EXIT_OK
    except Exception as e:  # noqa: BLE001
        if args.command == "snapshot":
            print(f"error: {e}", file=sys.stderr)
            return emit.EXIT_FAILED
        print(emit.RUN_EVERYTHING)
        print(f"warning: {e}", file=sys.stderr)
        return emit.EXIT_OK
    return _analyze(spark, args, previous, current, f)


def _baseline(spark: SparkSession, path: str | None) -> A.Snapshot | None:
    """The baseline of a manifest; one that cannot be read counts as none."""
    if not path:
        return None
    try:
        r = manifest.load_relations(spark, path)
        head = r["snapshot"].first()
        return A.Snapshot(head.tfm, head.scope, r["assembly"], r["method"], r["content_file"], head.version)
    except Exception as e:  # noqa: BLE001
        print(f"warning: the manifest cannot be read: {str(e)[:200]}", file=sys.stderr)
        return None


def _document(result: A.Result, table: DataFrame | None) -> None:
    """The whole result as one JSON document, written row by row."""
    head = {"runEverything": result.run_everything, "rule": result.rule, "reason": result.reason, "frontEnd": result.front_end, "warnings": result.warnings}
    out = sys.stdout
    out.write(json.dumps(head)[:-1])
    parts = (("assemblies", result.assemblies, ["name"]), ("changes", result.changes, ["assembly", "fqn"]), ("tests", result.selection, ["assembly", "display_name"]), ("filters", table, ["assembly"]))
    for name, rows, order in parts:
        out.write(f', "{name}": [')
        if rows is not None:
            for i, r in enumerate(rows.orderBy(*order).select(F.to_json(F.struct("*"))).toLocalIterator()):
                out.write((", " if i else "") + r[0])
        out.write("]")
    out.write("}\n")


def _analyze(spark: SparkSession, args: argparse.Namespace, baseline: A.Snapshot | None, current: A.Snapshot, f: dict[str, DataFrame]) -> int:
    changed = None
    if args.changed_files:
        with open(args.changed_files, encoding="utf-8") as lines:
            changed = changes.of_lines(spark, lines.read().splitlines())
    built: list[A.Graph] = []

    def graph() -> A.Graph:
        if not built:
            build = lambda: A.graph_of(args.test_framework, f, current.assembly.where("methods_analyzed").select("name"))
            built.append(cached_graph(spark, args.cache, current, args.test_framework, build))
        return built[0]

    points = f"{args.facts}/sequence_points"
    points = spark.read.parquet(points) if os.path.isdir(points) else None
    result = A.analyze(spark, baseline, current, graph, args.test_framework, changed, args.force_full_run_paths or None, points, f["types"], f["members"], args.always_run)
    table, code = A.report(result, args.test_framework, None, args.max_filter_clauses, args.assembly)
    for w in result.warnings:
        print(f"warning: {w}", file=sys.stderr)
    if args.explain:
        print(f"summary: {result.reason}")
        for r in emit.explained(result.selection).orderBy("display_name").toLocalIterator() if result.selection is not None else []:
            print(f"  {r.display_name}\n      why: {r.why}" + (f"\n      via: {r.via}" if r.via else ""))
        return code
    if args.format == "json":
        _document(result, table)
        return code
    rows = table.orderBy("assembly").collect() if table is not None else []  # one row for each test assembly
    if result.run_everything:
        print(emit.RUN_EVERYTHING if args.format == "filter-lines" else "")
        return code
    if args.format == "filter":
        text, state = emit.one_filter(rows, False)
        print(text)
        return state
    if args.format == "runsettings":
        if any(r["dialect"] == "TreeNode" for r in rows):
            return emit.EXIT_INEXPRESSIBLE
        for r in emit.run_settings(table).collect():
            with open(os.path.join(args.output_dir, f"{r['assembly']}.runsettings"), "w", encoding="utf-8") as out:
                out.write(r["content"])
        return code
    for r in emit.filter_lines(table).orderBy("assembly").collect():
        print(r["line"])
    return code


if __name__ == "__main__":
    sys.exit(main())
