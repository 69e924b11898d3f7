"""BPE encoding and decoding through a table of distinct words.

Whole texts are split into words (pieces of the tokenizer's own split) inside Spark tasks; each distinct word goes
through the tokenizer once, and the ids come back by position from that table. Decoding looks ids up in the
vocabulary, which is fixed, and joins the pieces by position.

The table of words belongs to a Python worker and outlives its tasks. A table for the whole corpus would have to be
joined back at every position of every text, and that shuffle is several times the corpus; a worker's own table needs
none. It starts anew beyond MOST_WORDS, so memory is bounded; results don't depend on it.

Defined results: null texts are empty and have no ids; empty texts likewise; the tokenizer's special strings inside a
text get their special ids; no text is cut, however long. Result columns replace columns of the input of that name.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import giving_back, in_chunks, ragged
from .tokenizer_file import load

CHUNK_BYTES = 1 << 20
MOST_WORDS = 200_000
#: Words encoded and, about, ids decoded at once.
ENCODED, DECODED = 2048, 1 << 17

Batches = Iterable[pa.RecordBatch]


class WordTable:
    """Distinct words with their ids, one after another in one array."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.file = load(path)
        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def add(self, words: list[str]) -> None:
        found: list[list[int]] = []
        for k in range(0, len(words), ENCODED):  # the library's results are far larger than the ids
            found += [e.ids for e in self.encoder.encode_batch_fast(words[k : k + ENCODED], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, flat])
        base = len(self.rows)
        self.rows.update((w, base + i) for i, w in enumerate(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end)."""
        if len(self.rows) > MOST_WORDS:
            self.clear()
        words: list[str] = []
        cuts = [0]
        for text in texts:
            words += self.file.split(text)
            cuts.append(len(words))
        new = [w for w in set(words) if w not in self.rows]
        if new:
            self.add(new)
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        lengths = self.lengths[rows]
        ends = np.r_[0, np.cumsum(lengths)]
        return self.ids[ragged(self.starts[rows], lengths)], ends[cuts]


_tables: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def _put(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    rest = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*batch.select(rest).columns, column], names=[*rest, name])


def encode_batches(path: str, text_column: str = "text", name: str = "ids") -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Adds `name`, the ids of the text as a list of 32-bit integers."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        words = word_table(path)
        for batch in in_chunks(batches, text_column, CHUNK_BYTES):
            ids, cuts = words.encode([t or "" for t in batch.column(text_column).to_pylist()])
            yield _put(batch, name, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32())))

    return run


def decode_batches(path: str, ids_column: str = "ids", name: str = "decoded") -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Adds `name`, the text of the ids; bytes that are no UTF-8 become U+FFFD, ids that are not in the vocabulary nothing."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        pieces = load(path).pieces
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        sizes = np.array([len(p) for p in table], np.int64)
        blob, starts = np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes

        def texts_of(column: pa.ListArray) -> list[str]:
            ids = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(sizes[ids])]
            raw = blob[ragged(starts[ids], sizes[ids])].tobytes()
            cuts = ends[np.r_[0, np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))]].tolist()
            return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]

        for batch in batches:
            column = batch.column(ids_column)
            rows = max(1, DECODED // max(1, len(column.flatten()) // max(1, len(column))))
            texts = [t for k in range(0, len(column), rows) for t in texts_of(column.slice(k, rows))]
            yield _put(batch, name, pa.array(texts, pa.string()))

    return run


def _with(df: DataFrame, name: str, kind: T.DataType, run: Callable) -> DataFrame:
    rest = [f for f in df.schema.fields if f.name != name]
    return df.mapInArrow(giving_back(run), T.StructType([*rest, T.StructField(name, kind)]))


def encode(docs: DataFrame, path: str, text_column: str = "text", name: str = "ids") -> DataFrame:
    return _with(docs, name, T.ArrayType(T.IntegerType()), encode_batches(path, text_column, name))


def decode(encoded: DataFrame, path: str, ids_column: str = "ids", name: str = "decoded") -> DataFrame:
    return _with(encoded, name, T.StringType(), decode_batches(path, ids_column, name))
