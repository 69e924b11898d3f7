"""The registered queries of the training-data operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, mixing, page_text, repetition, simhash, site_quality, suffix_dedup, token_counts
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def digest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of batches that have ids and decoded."""
    for batch in batches:
        lists = batch.column("ids")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        hashes, at = [], 0
        for n in counts:
            hashes.append(hashlib.sha256(flat[at : at + n].tobytes()).hexdigest())
            at += n
        decoded = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in batch.column("decoded").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    encode, decode = bpe.encode_batches(path), bpe.decode_batches(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digest_batches(decode(encode(batches)))

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source and its path the language within it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return site_quality.judge(docs, labels, F.col("source"), F.col("lang"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_chats(rows.unionByName(planted)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_page_text, op2_bpe, op3_suffix_dedup, op4_simhash, op5_mixing, op6_site_quality, op7_nearest, op8_token_counts, op9_quality_rules, op10_chat)}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.ORACLE_SQL, "op10_chat": chat.ORACLE_SQL}
