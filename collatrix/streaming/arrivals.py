"""Changes of documents as their versions arrive: each new version against the one before it.

A stream of versions (series, version, doc_id, text) is taken batch by batch. A batch writes its versions and their changes into folders
of its own number, and reads the versions of smaller numbers, so a batch that runs again after a failure writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alignment

VERSIONS = "series string, version int, doc_id long, text string"


def read_versions(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """The stream of versions in Parquet files that arrive in a folder."""
    return spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def neighbours(known: DataFrame, arrived: DataFrame) -> DataFrame:
    """(a, b): each arrived version with the one before it in its series, arrived or known."""
    one = lambda df, new: df.select("series", "version", "doc_id", F.lit(new).alias("new"))
    only = known.join(arrived.select("series").distinct(), "series", "left_semi")
    order = W.partitionBy("series").orderBy("version", "doc_id")
    rows = one(only, False).unionByName(one(arrived, True)).withColumn("a", F.lag("doc_id").over(order))
    return rows.where("new and a is not null").select("a", F.col("doc_id").alias("b"))


def changes_of_arrivals(versions: DataFrame, kept: str, changes: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream: versions are kept in `kept` and changes written to `changes`, by batch."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{kept}/batch={number}"
        batch.dropDuplicates(["doc_id"]).write.mode("overwrite").parquet(target)
        arrived = spark.read.schema(VERSIONS).parquet(target)
        before = spark.read.schema(f"{VERSIONS}, batch long").option("basePath", kept).parquet(kept).where(F.col("batch") < number)
        pairs = neighbours(before, arrived)
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        texts = before.select("doc_id", "text").union(arrived.select("doc_id", "text")).join(wanted, "doc_id", "left_semi")
        found = alignment.changes(alignment.edit_steps(pairs, alignment.tokens_of(texts)))
        found.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    return versions.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
