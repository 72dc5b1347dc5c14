"""Corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

1. quality rules: documents that the threshold table rejects go.
2. line dedup: lines that an earlier document holds go from the texts.
3. n-gram Jaccard join: one document of each group of near copies stays, the one with the smallest doc_id.
4. benchmark decontamination: contaminated documents go.
5. SentencePiece encoding: token ids of what is left, and the check that they decode to the text.

Stages 1 to 4 return the columns of documents; n_chars follows a text that changes.

Defined results: a null or empty text fails the quality rules and goes; a text that loses all its lines stays, is empty and has
no tokens; of repeated rows (same doc_id and text) all stay or go together, and of copies under several ids the smallest stays;
a row without doc_id owns no line and stays where it isn't contaminated; columns whose names clash with a stage's own are
carried through stages 1 to 4 as they are; an empty table gives an empty one. A stage's table is deleted when the next one's is
written; the last one's stays in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_dedup, ngram_join, quality_rules, sentencepiece_codec
from tidemark.llm.common import drop, shared_folder, written
from tidemark.llm.queries import TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clashing = {c: f"__own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = line_dedup.dedup(docs.withColumnsRenamed(clashing))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(clashing.get(c, c)).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.Pieces.load(TOKENIZER)
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(docs.select("doc_id", "text", "lang", "source"), model), model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", tokens),
]
#: SQL can't express near copies' components or the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = shared_folder(spark)
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            drop(spark, before)
        before = path
    return docs
