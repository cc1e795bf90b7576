"""Lists of changed files, and unified diffs, as changed ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CHANGED_RANGE, WHOLE_FILE

_DIFF = r"^(\+\+\+ |--- |@@ )"
_HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"
_LINES = r"^(.*):([0-9]+)(?:-([0-9]+))?$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, line) of text files, with line numbers; empty lines are left out."""
    text = spark.read.option("wholetext", True).text(path).withColumn("source", F.input_file_name())
    out = text.select("source", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return out.where("line <> ''")


def parse_list(rows: DataFrame) -> DataFrame:
    """Ranges of `path`, `path:12` and `path:12-34` lines; blanks and # comments are skipped.

    What follows the last colon counts only if it is a positive line or a range that does not fall;
    else the whole string is a path, and the whole file changed.
    """
    text = F.trim("line")
    a = F.regexp_extract(text, _LINES, 2).try_cast("int")
    b = F.coalesce(F.nullif(F.regexp_extract(text, _LINES, 3), F.lit("")), F.regexp_extract(text, _LINES, 2)).try_cast("int")
    ok = text.rlike(_LINES) & F.coalesce((a > 0) & (b >= a), F.lit(False))
    kept = rows.where((text != "") & ~text.startswith("#"))
    return kept.select(
        F.when(ok, F.regexp_extract(text, _LINES, 1)).otherwise(text).alias("path"), F.when(ok, a).otherwise(1).cast("int").alias("start_line"), F.when(ok, b).otherwise(WHOLE_FILE).cast("int").alias("end_line")
    )


def parse_diff(rows: DataFrame, source: str = "source") -> DataFrame:
    """Ranges of a unified diff's hunks: a +++ line names the file of the hunks behind it.

    A hunk covers its new lines; one that only deletes counts as the line before it (line 1 at
    least). Hunks of /dev/null count for nothing. Order matters within a source alone.
    """
    w = Window.partitionBy(source).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col("line").startswith("+++ "), F.substring_index(F.substring("line", 5, 1 << 20), "\t", 1))
    at = F.regexp_extract("line", _HUNK, 1).try_cast("int")
    size = F.coalesce(F.regexp_extract("line", _HUNK, 2).try_cast("int"), F.lit(1))
    hunk = rows.where(F.col("line").rlike(_DIFF)).withColumn("path", F.last(name, ignorenulls=True).over(w))
    hunk = hunk.where(F.col("line").rlike(_HUNK) & F.col("path").isNotNull() & (F.trim("path") != "/dev/null"))
    return hunk.select(F.trim("path").alias("path"), F.greatest(at, F.lit(1)).alias("start_line"), F.when(size > 0, at + size - 1).otherwise(F.greatest(at, F.lit(1))).cast("int").alias("end_line"))


def parse(rows: DataFrame) -> DataFrame:
    """Either form, by what the lines look like."""
    is_diff = rows.agg(F.coalesce(F.bool_or(F.col("line").rlike(_DIFF)), F.lit(False))).first()[0]
    return parse_diff(rows) if is_diff else parse_list(rows)


def of_lines(spark: SparkSession, given: list[str]) -> DataFrame:
    """parse() of lines that the driver holds."""
    kept = [x for x in given if x]
    if not kept:
        return spark.createDataFrame([], CHANGED_RANGE)
    return parse(spark.createDataFrame([("given", i, x) for i, x in enumerate(kept)], "source string, line_no int, line string"))
