"""Document fingerprints of closed syncmers, in DataFrame functions alone.

A text is a sequence of units: its words, and the characters of words of more than LONG_WORD
characters (as in scripts without spaces); what a word becomes depends on the word alone. A run of
RUN units is a closed syncmer if the least of the hashes of its inner runs of INNER units stands at
its first or its last place. That depends on the run alone, not on what surrounds it, so two texts
that share a passage share its anchors wherever it stands. Of any RUN - INNER neighbouring runs at
least one is closed, so an anchor stands at most that many units behind the one before it.

A fingerprint is the list of all anchors in their order, each a 32-bit number: 30 bits of the run's
hash, and two of the distance from the anchor before (from place -1 for the first), which gives
every anchor's place. The likeness of two fingerprints is the Jaccard similarity of their sets of
anchors' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K

#: Units of a run and of an inner run (the expressions below are for these two), and the longest word that is one unit.
RUN, INNER, LONG_WORD = 5, 2, 40
_BLANK = "\\\\x20\\\\x09-\\\\x0D"


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """Adds _w, the hashes of the units, _s, those of neighbouring units, and _p, the places of the closed runs."""
    df = df.withColumn("_t", F.expr(f"array_remove(split({text}, '[{_BLANK}]+'), '')"))
    cut = f"array_remove(flatten(transform(_t, x -> if(char_length(x) > {LONG_WORD}, split(x, ''), array(x)))), '')"
    units = f"CASE WHEN {text} RLIKE '[^{_BLANK}]{{{LONG_WORD + 1}}}' THEN {cut} ELSE _t END"
    df = df.withColumn("_w", F.expr(f"transform({units}, x -> xxhash64(x))")).drop("_t")
    pairs = "CASE WHEN size(_w) > 1 THEN zip_with(slice(_w, 1, size(_w) - 1), slice(_w, 2, size(_w) - 1), (a, b) -> xxhash64(a, b)) ELSE array() END"
    df = df.withColumn("_s", F.expr(pairs))
    closed = "least(_s[i], _s[i + 3]) <= least(_s[i + 1], _s[i + 2])"
    return df.withColumn("_p", F.expr(f"CASE WHEN size(_w) >= {RUN} THEN filter(sequence(0, size(_w) - {RUN}), i -> {closed}) ELSE array() END"))


#: A run's hash, and the hash of a text that is shorter than a run.
_RUN_HASH, _SHORT_HASH = "xxhash64(_s[i], _s[i + 2], _w[i + 4])", "xxhash64(array_join(transform(_w, x -> string(x)), ' '))"


def anchors(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per closed syncmer: the columns keep, place (its first unit's number) and anchor (its
    64-bit hash). A text of fewer than RUN units is one anchor; one without words has none."""
    src = K.cast_text(df, keep).withColumn("text", F.coalesce("text", F.lit("")))
    full = f"CASE WHEN size(_w) >= {RUN} THEN transform(_p, i -> struct(i AS place, {_RUN_HASH} AS anchor)) WHEN size(_w) > 0 THEN array(struct(0 AS place, {_SHORT_HASH} AS anchor)) ELSE array() END"
    out = _hashed(src, "text").withColumn("_a", F.explode(F.expr(full)))
    return out.select(*keep, F.col("_a.place").alias("place"), F.col("_a.anchor").alias("anchor"))


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column (not null) as an array of integers."""
    word = "int(shiftright({h}, 32)) & -4 | {d}"
    runs = f"transform(_p, (i, j) -> {word.format(h=_RUN_HASH, d='i - coalesce(get(_p, j - 1), -1)')})"
    full = f"CASE WHEN size(_w) >= {RUN} THEN {runs} WHEN size(_w) > 0 THEN array({word.format(h=_SHORT_HASH, d='1')}) ELSE array() END"
    return _hashed(df, text).withColumn(name, F.expr(full)).drop("_w", "_s", "_p")


def digits(name: str) -> Column:
    """Eight hexadecimal digits for each anchor."""
    return F.expr(f"array_join(transform({name}, x -> lower(lpad(hex(bigint(x) & 4294967295L), 8, '0'))), '')")


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the likeness of two fingerprints, 0 to 1; two empty ones are alike."""
    sets = {f"_{x}": F.expr(f"array_distinct(transform({c}, x -> x & -4))") for x, c in (("l", a), ("r", b))}
    df = df.withColumns(sets).withColumn("_both", F.expr("size(array_intersect(_l, _r))"))
    share = "CASE WHEN size(_l) + size(_r) = 0 THEN 1D ELSE _both / double(size(_l) + size(_r) - _both) END"
    return df.withColumn(name, F.expr(share)).drop("_l", "_r", "_both")


def with_next(df: DataFrame, key: str, columns: list[str], tie: str, parts: int | None = None) -> DataFrame:
    """Adds next_<column>: the value in the next row by ascending key, in the first row after the last.

    Rows of one key are ordered by tie; a null key comes last. Rows are dealt out by key ranges; the
    first row of each range is copied to the range before, so no task sees more than its range.
    Two passes over the key alone find the ranges, of which the driver gets one row each.
    """
    spark = df.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # several ranges a task even out
    number = F.col(key).try_cast("double")
    cuts = sorted(set(df.select(number.alias("x")).where("x is not null").approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    steps = len(cuts).bit_length()
    if cuts:
        # binary search: the number of cuts that are not above the key
        top = F.lit(cuts + [float("inf")] * ((1 << steps) - len(cuts)))
        bucket = F.aggregate(F.lit([1 << i for i in range(steps - 1, -1, -1)]), F.lit(0), lambda at, step: F.when(F.get(top, at + step - 1) <= number, at + step).otherwise(at))
        bucket = F.when(number.isNull(), F.lit(len(cuts) + 1)).otherwise(bucket)
    else:
        bucket = F.when(number.isNull(), F.lit(1)).otherwise(F.lit(0))
    dealt = df.withColumn("_bucket", bucket)
    heads = {r["_bucket"]: r["head"] for r in dealt.groupBy("_bucket").agg(F.min(key).alias("head")).collect()}  # one row for each range
    there = sorted(heads)
    n = len(cuts) + 2
    kind = df.schema[key].dataType
    first = F.lit([heads.get(i) for i in range(n)]).cast(f"array<{kind.simpleString()}>") if there else F.lit(None)
    before = {b: there[i - 1] for i, b in enumerate(there)}
    back = F.lit([before.get(i, 0) for i in range(n)])
    if not there:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    is_head = F.get(first, F.col("_bucket")).eqNullSafe(F.col(key))
    copies = F.when(is_head, F.array(F.struct(F.col("_bucket").alias("at"), F.lit(0).alias("copy")), F.struct(F.get(back, F.col("_bucket")).alias("at"), F.lit(1).alias("copy")))).otherwise(
        F.array(F.struct(F.col("_bucket").alias("at"), F.lit(0).alias("copy")))
    )
    rows = dealt.withColumn("_place", F.explode(copies)).select("*", F.col("_place.at").alias("_at"), F.col("_place.copy").alias("_copy")).drop("_place", "_bucket")
    w = Window.partitionBy("_at").orderBy("_copy", F.col(key).asc_nulls_last(), tie)
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return rows.where("_copy = 0").drop("_at", "_copy")


def judge(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last half of its code points replaced by the next text's first as many
    (or all it has). Null counts as empty; an empty text's fingerprint is empty, and so is that of a
    text of white space. Rows of equal key stand in the order of their texts, null keys behind all
    others; repeated rows stay. The only row of a table is its own next; an empty table gives no rows.
    """
    docs = df.select(F.col(key), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = with_next(fingerprint(docs, "text", "fp"), key, ["text", "fp"], "text")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.col("n_chars").cast("int") - half), F.left(F.col("next_text"), half))
    docs = docs.select(key, "n_chars", "fp", "next_fp", edited.alias("edited"))
    docs = fingerprint(docs.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fp").drop("edited")
    docs = likeness(likeness(docs, "fp", "edited_fp", "near_edited"), "fp", "next_fp", "near_next")
    return docs.select(key, "n_chars", "edited_sha256", digits("fp").alias("fingerprint"), digits("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")
