"""The operators' registered queries: each applies its operator to its whole table.

What they return for null, empty and repeated rows and for empty tables is said where the operators
are defined; columns that the queries do not name have no part in the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_extract, packing, quality_classifier, quality_rules, secret_scan, simhash, syncmers, toxicity, url_filter
from ._kernel import table

#: Name of the byte-level vocabulary among the public tokenizers.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs), ["doc_id"]).drop("redacted_text")


def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES, ["page_id"])


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path(), ["doc_id"])


def op5_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), ["doc_id"])


def op6_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.judge(table(spark, sf_dir, "documents"))


def op9_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.judge(table(spark, sf_dir, "documents"))


def op10_empirical_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.fit(), ["page_id", "url"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_crf_secrets": op2_crf_secrets,
    "op3_url_cascade": op3_url_cascade,
    "op4_bpe_transducer": op4_bpe_transducer,
    "op5_nnls_packing": op5_nnls_packing,
    "op6_rule_cascade": op6_rule_cascade,
    "op7_simhash_mih": op7_simhash_mih,
    "op8_dom_trees": op8_dom_trees,
    "op9_closed_syncmers": op9_closed_syncmers,
    "op10_empirical_bayes_quality": op10_empirical_bayes_quality,
}

ORACLES: dict[str, str] = {
    "op3_url_cascade": url_filter.ORACLE,
    "op6_rule_cascade": quality_rules.ORACLE,
}
