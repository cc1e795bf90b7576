"""Corpus pipeline: toxicity, quality, near-duplicates, secrets, packing.

Every stage works on all rows that the stage before it kept. A stage's result is written as
Parquet and read again as the next stage's documents; all but the last have the columns of
documents, whatever those are.

* toxicity drops documents that score as toxic;
* quality drops documents below the quality threshold;
* near_duplicates keeps one document of each group (five-word shingles, similarity 0.8 and more): the
  one of least doc_id (without an id: after all others), and one row of repeated rows. Of rows of
  equal doc_id and text, the one whose other columns are the least as JSON stays;
* secrets replaces secrets in the text, and sets n_chars to the new length;
* packing gives the pieces of the packed sequences.

A null text counts as empty and stays a row; an empty table stays empty through all stages. Columns
beyond those of documents are carried through as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleflow.llm import _kernel as K
from rippleflow.llm import near_copies, packing, quality_classifier, secret_scan, toxicity
from rippleflow.llm.queries import vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, as they are."""
    model = toxicity.fit(docs, K.table(spark, sf_dir, "labels"))
    scored = toxicity.score(K.packed(docs), model, ["_row", "text"])
    return K.unpacked(scored.where(F.col("score") < toxicity.THRESHOLD), docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the quality threshold, as they are; hosts are sources, paths languages."""
    model = quality_classifier.fit(docs, K.table(spark, sf_dir, "labels"))
    rows = K.packed(docs).withColumns({"host": F.col("_row.source"), "path": F.col("_row.lang")})
    judged = K.stored(quality_classifier.evidence(rows, model, ["_row", "text", "host", "path"]))
    scored = quality_classifier.shrink(judged, "host", "path")
    return K.unpacked(scored.where(F.col("score") >= quality_classifier.THRESHOLD), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, as it is."""
    K.tune(spark)
    key = F.struct(F.col("_row.doc_id").isNull().alias("missing"), F.coalesce(F.col("_row.doc_id"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text")).alias("_key")
    rows = K.packed(docs).select("_row", "text", key)
    near = near_copies.near_duplicates(rows, "_key")
    kept = K.stored(near.where(F.col("_key") == F.col("component_id")).groupBy("_key").count())
    # a row that stands once is let through; of rows that are alike, one is
    once = rows.join(kept.where("count = 1").select("_key"), "_key", "left_semi").select("_row", "text")
    again = kept.where("count > 1").select("_key")
    if again.limit(1).count():
        alike = rows.join(again, "_key", "left_semi").groupBy("_key").agg(F.min_by(F.struct("_row", "text"), F.to_json("_row")).alias("_one"))
        once = once.unionByName(alike.select("_one.*"))
    return K.unpacked(once, docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars set to the new length."""
    K.tune(spark)
    field = secret_scan.fit(docs)
    found = secret_scan.scan(K.packed(docs), field, ["_row"])
    text = F.col("redacted_text")
    return K.unpacked(found, docs.columns, text=text, n_chars=F.char_length(text).cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of all documents."""
    K.tune(spark)
    return packing.pack(docs, vocabulary_path(), ["doc_id"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: SQL cannot express the learned stages; tests hold each stage against the labels of a made corpus, the
#: near-duplicate stage against all pairs, and packing against the library's ids.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = K.table(spark, sf_dir, "documents")
    before: list[DataFrame] = []
    for _, stage in STAGES:
        docs = K.stored(stage(spark, docs, sf_dir))
        K.discard(*before)  # what the stage read
        before = [docs]
    return docs
