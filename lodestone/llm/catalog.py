"""The registered queries of this package."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, htmltext, licenses, linededup, neardup, oracles, packing, pii, quality, suffixtree, topk
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


# -- what SQL can express of operators whose other columns it can't -----------


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 without the method's own labels."""
    return op4_license_scan(spark, sf_dir).drop("labels", "score", "detections")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 without the forest's verdict."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 without the tree's score; the base score in thousandths, as sums of logs differ in the last places."""
    milli = F.round(F.col("base_score") * 1000).cast("long").alias("base_milli")
    return op9_suffix_tree(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", milli)


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 without what is hidden."""
    return op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_near_dedup": op3_near_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_text": op6_html_text,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_top_k": op8_top_k,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_pii": op10_pii,
    "license_phrases": license_phrases,
    "quality_counts": quality_counts,
    "word_scores": word_scores,
    "pii_counts": pii_counts,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": linededup.ORACLE,
    "op3_near_dedup": oracles.NEAR_DEDUP,
    "op8_top_k": oracles.TOP_K,
    "license_phrases": oracles.LICENSES,
    "quality_counts": oracles.QUALITY,
    "word_scores": oracles.SUFFIX_TREE,
    "pii_counts": oracles.PII,
}
