"""Runner filters and reports from a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import escape_filter, escape_xml, leaf_name, pretty_key

MAX_CLAUSES = 200
RUN_EVERYTHING = "RUN_EVERYTHING"
EXIT_OK, EXIT_FAILED, EXIT_INEXPRESSIBLE, EXIT_NOTHING = 0, 1, 2, 3


def _alternatives(values: Column) -> Column:
    return F.when(F.size(values) == 0, F.lit("*")).otherwise(F.concat(F.lit("("), F.array_join(F.sort_array(values), "|"), F.lit(")")))


def filters(selection: DataFrame, dialect: str, dlls: DataFrame | None = None, max_clauses: int = MAX_CLAUSES) -> DataFrame:
    """(assembly, dll, test_count, run_whole_assembly, dialect, filter), one row per assembly.

    VsTest: clauses by name, ~ for parameterised tests, joined in name order. TreeNode: one path with
    the classes and the test names as alternatives. Beyond max_clauses tests the whole assembly
    runs and the filter is empty; its clauses are cut short while they are gathered, since they are
    not shown. dlls (name, dll) are found without case.
    """
    tests = selection.groupBy("assembly", "display_name").agg(F.min(F.struct("parameterized", "class_name")).alias("_t")).select("assembly", "display_name", "_t.*")
    counts = tests.groupBy("assembly").agg(F.count("*").alias("test_count"))
    small = tests.join(counts.where(F.col("test_count") <= max_clauses).select("assembly"), "assembly", "left_semi")
    if dialect == "TreeNode":
        names, classes = F.collect_set(leaf_name(F.col("display_name"), F.col("parameterized"))), F.collect_set(F.when(F.col("class_name") != "", F.col("class_name")))
        text = small.groupBy("assembly").agg(F.concat(F.lit("/"), F.first("assembly"), F.lit("/*/"), _alternatives(classes), F.lit("/"), _alternatives(names)).alias("filter"))
    else:
        clause = F.concat(F.lit("FullyQualifiedName"), F.when(F.col("parameterized"), F.lit("~")).otherwise(F.lit("=")), escape_filter(F.col("display_name")))
        ordered = F.sort_array(F.collect_list(F.struct("display_name", clause.alias("clause"))))
        text = small.groupBy("assembly").agg(F.array_join(F.transform(ordered, lambda x: x["clause"]), "|").alias("filter"))
    out = counts.join(text, "assembly", "left")
    if dlls is not None:
        out = out.join(dlls.groupBy(F.lower("name").alias("_k")).agg(F.min("dll").alias("dll")), F.lower("assembly") == F.col("_k"), "left").drop("_k")
    else:
        out = out.withColumn("dll", F.lit(None).cast("string"))
    whole = F.col("test_count") > max_clauses
    return out.select("assembly", "dll", "test_count", whole.alias("run_whole_assembly"), F.lit(dialect).alias("dialect"), F.coalesce("filter", F.lit("")).alias("filter"))


def one_filter(rows: list, run_everything: bool) -> tuple[str, int]:
    """The filter of all assemblies together and the exit code; rows are filters() rows by assembly."""
    if run_everything or any(r["run_whole_assembly"] for r in rows):
        return "", EXIT_OK
    if len(rows) > 1 and any(r["dialect"] == "TreeNode" for r in rows):
        return "", EXIT_INEXPRESSIBLE
    return "|".join(r["filter"] for r in rows), exit_code(run_everything, len(rows))


def filter_lines(table: DataFrame) -> DataFrame:
    """(line): dll or assembly, dialect and filter, separated by tabs, by assembly."""
    line = F.concat_ws("\t", F.coalesce("dll", "assembly"), "dialect", "filter")
    return table.select("assembly", line.alias("line"))


def run_settings(table: DataFrame) -> DataFrame:
    """(assembly, content): a settings file for each assembly; only for the VsTest dialect."""
    body = F.when(F.col("run_whole_assembly"), F.lit("")).otherwise(escape_xml(F.col("filter")))
    parts = ['<?xml version="1.0" encoding="utf-8"?>\n<RunSettings>\n  <RunConfiguration>\n    <TestCaseFilter>', "</TestCaseFilter>\n  </RunConfiguration>\n</RunSettings>"]
    return table.select("assembly", F.concat(F.lit(parts[0]), body, F.lit(parts[1])).alias("content"))


def explained(selection: DataFrame) -> DataFrame:
    """(display_name, why, via): the selection for readers."""
    via = F.when(F.size("chain") > 1, F.array_join(F.transform("chain", pretty_key), "\n        -> "))
    return selection.select("display_name", F.col("reason").alias("why"), via.alias("via"))


def exit_code(run_everything: bool, n_filters: int) -> int:
    return EXIT_OK if run_everything or n_filters else EXIT_NOTHING
