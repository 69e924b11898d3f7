"""Readers: tables, PDF files by content hash, review texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """PDF files under `path`, one row a content: doc_id (SHA-256), path, content; those in `known` (doc_id) left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    pdf = F.lower("path").endswith(".pdf") | (F.substring("content", 1, 5) == F.lit(b"%PDF-"))
    found = files.where(pdf).select(F.sha2("content", 256).alias("doc_id"), "path", "content").dropDuplicates(["doc_id"])
    return found if known is None else found.join(known.select("doc_id"), "doc_id", "left_anti")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review texts (Markdown or plain text), a row a file: review_id (SHA-256 of the text), path, text."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.where(F.lower("path").rlike(r"\.(md|markdown|txt)$")).select(F.sha2("value", 256).alias("review_id"), "path", F.col("value").alias("text"))
