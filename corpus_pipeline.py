"""From documents to token ids: the corpus operators as stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideglass.llm import langid, tables
from tideglass.llm.decontaminate import benchmark_hits
from tideglass.llm.line_dedup import line_dedup
from tideglass.llm.minhash import near_duplicates
from tideglass.llm.pieces import piece_ids
from tideglass.llm.queries import piece_model, read

LEAST_LANGUAGE_SCORE = 0.1  # share of a text's n-grams that its language has; texts below are no language of the corpus


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one that no operator touches, whatever their names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_row"))


def unpacked(rows: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The columns as they were, but for those changed."""
    return rows.select([(changed[c] if c in changed else F.col(c) if c in ("doc_id", "text") else F.col("_row")[c]).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents are in; those without a letter or like none of these go."""
    out = langid.predict(packed(docs), langid.fit(docs))
    return unpacked(out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows. Null texts stay null."""
    rows = packed(docs).withColumn("_null", F.col("text").isNull())
    out = line_dedup(rows, carry=("_row", "_null"))
    text = F.when(~F.col("_null"), F.col("kept"))
    return unpacked(out, docs.columns, text=text, n_chars=F.length(text).cast("long"))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates. Rows with equal ids are one document."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    out = benchmark_hits(packed(docs), read(spark, sf_dir, "benchmark"), carry=("text", "_row"))
    return unpacked(out.where(F.size("starts") == 0), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the digest of what they decode to: doc_id, n_tokens, ids, decoded_sha256."""
    out = piece_ids(docs, piece_model())
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]
ORACLE_SQL = None  # language ID and SentencePiece are beyond SQL; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.staged(stage(spark, docs, sf_dir), name)
    return docs
