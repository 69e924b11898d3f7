"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space; `bytes.split()` cuts at the same six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage by a reliable checkpoint in the folder that the cluster names.

    `spark.checkpoint.dir` is read from the session. Only in local mode, as in tests, is a folder chosen here where it is
    unset; on a cluster that would be lost with a machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or "/tmp/collatrix-checkpoints")
    return df.checkpoint(eager=True)


def renamed(df: DataFrame, columns: list[str]) -> tuple[list, list[str]]:
    """(`columns` of `df` under names that nothing else has, those names): what is added beside them can't clash."""
    own = [f"_column{i}" for i in range(len(columns))]
    return [F.col(f"`{c}`").alias(n) for c, n in zip(columns, own)], own


def small(rows: DataFrame, most: int) -> DataFrame:
    """`rows`, short and checkpointed as they are counted here, marked for broadcast if there are no more than `most`."""
    return F.broadcast(rows) if rows.count() <= most else rows


def give_back() -> None:
    """Returns memory that this Python worker has freed to the system: workers outlive their tasks, several in a machine."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def giving_back(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` on the batches of a task, and after them the memory that it used goes back."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def text_or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (shift, multiply, shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def in_chunks(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in which `column` has about `most_bytes` at most, or one row. No row is lost or cut."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size) + 64
        if batch.num_rows > start:
            yield batch.slice(start)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], …, starts[i] + lengths[i] - 1 for each i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    offsets = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - offsets, lengths)
