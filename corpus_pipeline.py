"""The corpus pipeline: stages that each take documents and hand on what they keep.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents; the last returns each document of the mix with its token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm import bpe, mixing, repetition, simhash, suffix_dedup
from collatrix.llm.common import checkpointed, table
from collatrix.llm.queries import tokenizer_path

WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on length and repetition, as they are. Null and empty texts have no words and go;
    repeated rows are judged alike."""
    return repetition.apply_rules(docs, only_kept=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies (five-word shingles, similarity 0.8 or more, every link): the
    one with the least id. Texts without words are copies of each other; rows that share an id stay or go together; rows
    without id stay only where their group has no id."""
    return simhash.one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 100 bytes that start earlier; n_chars follows the text. Null texts stay
    null; rows of one id count as one document; a null id comes first."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, whatever its other columns are named. A null text has size 0, a
    null source is a source of its own, and repeated rows are decided alike."""
    return mixing.emit(docs, WEIGHTS, MOST_EPOCHS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document of the mix with its ids and their number in the place of its text (null: no ids). Columns of the
    input of those names are replaced."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars", "ids", "n_tokens")]
    encoded = bpe.encode(docs.select(*rest, "text"), tokenizer_path())
    return encoded.select(*rest, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("source_mix", source_mix),
    ("tokenize", tokenize),
]

#: SQL has neither the fingerprints' hash nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
