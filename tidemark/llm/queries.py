"""The operators applied to the driver's tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, license_scan, line_dedup, ngram_join, oracle, quality_gbt, quality_rules, sentencepiece_codec, substring_dedup, url_filter, warc
from tidemark.llm.common import shared_folder
from tidemark.llm.url_filter import UrlRule


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The vocabulary file of a public tokenizer; TIDEMARK_TOKENIZER names another.
TOKENIZER = os.environ.get("TIDEMARK_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")
URL_RULES = [UrlRule("allow", "com/"), UrlRule("block", "example.com/en/"), UrlRule("allow", "www.example.com/en/"), UrlRule("block", "net/es/"), UrlRule("block", "net/fr/")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontam.judge(docs, _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256)
    return judged.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), items.alias("items_sha256"), "contaminated", "n_near_items")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs)
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "best_license", F.round("best_dice", 6).alias("best_dice"), "n_passages")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.Pieces.load(TOKENIZER)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, model), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_gbt.classify(docs, _table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    warc.write(_table(spark, sf_dir, "pages"), f"{folder}/monolithic")
    archives = warc.normalise(spark, f"{folder}/monolithic", f"{folder}/normalised")
    return warc.read(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_url_filters, op3_ngram_jaccard_join, op4_benchmark_decontamination, op5_license_scans, op6_substring_dedup, op7_sentencepiece, op8_quality_rules, op9_quality_classifier, op10_warc)}


def oracle_sql() -> dict[str, str]:
    """SQL can't express op7 (a tokenizer) and op9 (a fitted model); tests hold these to the tokenizer's library and to held-out accuracy."""
    return {
        "op1_line_dedup": oracle.line_dedup(),
        "op2_url_filters": oracle.url_filter(URL_RULES),
        "op3_ngram_jaccard_join": oracle.ngram_join(),
        "op4_benchmark_decontamination": oracle.decontamination(),
        "op5_license_scans": oracle.license_scan(),
        "op6_substring_dedup": oracle.substring_dedup(),
        "op8_quality_rules": oracle.quality_rules(),
        "op10_warc": oracle.warc(),
    }
