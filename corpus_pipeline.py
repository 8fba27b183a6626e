"""The corpus pipeline: rejected documents go, shared lines go, one of each group of near
duplicates stays, secrets are blanked out, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one
reads it. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import lines, minhash, packing, quality, secrets
from pagemill.llm.common import stored, unpacked
from pagemill.llm.queries import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word statistics or the line model reject go."""
    model = quality.fit_lines(docs, table(spark, sf_dir, "labels"))
    return unpacked(quality.label_lines(docs, model, carry=True).where("kept"), docs.columns, "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in one of them."""
    return unpacked(lines.dedup_lines(docs, carry=True), docs.columns, "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays. Of rows that share a doc_id all stay if one does."""
    found = minhash.near_duplicates(docs, words=5, percent=80)
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("stays")).where("NOT stays").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become [secret]."""
    return unpacked(secrets.find_secrets(docs, secrets.fit_tokens(docs), carry=True), docs.columns, "redacted")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row per piece."""
    added = packing.added_tokens(tokenizer_path("byte_bpe_50k.json"))
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.tiktoken"), end_id=1, added=added)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The line and token models and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is stored in shared storage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
