"""Token counts by byte-pair merging on a heap and a linked list, without identifiers.

A word starts as its bytes in a doubly linked list, with every adjacent pair that the file can merge on a heap by rank
and place. The least pair is popped; if both its symbols still stand, the left one takes the merged symbol, the right
one leaves the list, and the two new neighbour pairs are pushed. The count of a word is its bytes less its merges. A
word is counted once in each Python worker, up to MOST_WORDS of them held at a time.

Defined results: null and empty texts have no bytes and no tokens; a special string of the tokenizer is one token;
texts of any length are counted whole. Result columns replace columns of the input of that name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_chunks
from .tokenizer_file import TokenizerFile, load

CHUNK_BYTES = 4 << 20
MOST_WORDS = 500_000


def count_word(word: bytes, file: TokenizerFile) -> int:
    """Tokens of one piece: initial symbols minus merges."""
    n = len(word)
    if n < 2:
        return n
    known = file.merges.get
    symbols = list(map(file.byte_ids.__getitem__, word))
    heap = []
    for i in range(n - 1):
        found = known(symbols[i] << 32 | symbols[i + 1])
        if found:
            heap.append((found[0], i, found[1]))
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        rank, i, merged = heappop(heap)
        j = after[i]
        if symbols[i] < 0 or j >= n:
            continue
        found = known(symbols[i] << 32 | symbols[j])
        if not found or found[0] != rank:
            continue
        symbols[i], symbols[j] = merged, -1
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            found = known(merged << 32 | symbols[k])
            if found:
                heappush(heap, (found[0], i, found[1]))
        h = before[i]
        if h >= 0:
            found = known(symbols[h] << 32 | merged)
            if found:
                heappush(heap, (found[0], h, found[1]))
    return n - merges


class Counter:
    def __init__(self, path: str) -> None:
        self.file = load(path)
        self.counts: dict[str, int] = {}

    def count(self, text: str) -> int:
        pieces = self.file.split(text)
        try:
            return sum(map(self.counts.__getitem__, pieces))
        except KeyError:
            counts, special, file = self.counts, self.file.special, self.file
            if len(counts) > MOST_WORDS:
                counts.clear()
            for p in set(pieces):
                if p not in counts:
                    counts[p] = 1 if p in special else count_word(p.encode("utf-8", "surrogatepass"), file)
            return sum(map(counts.__getitem__, pieces))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, text_column: str = "text", keep: list[str] | None = None, limit: int = 512) -> DataFrame:
    """The `keep` columns with n_bytes, n_tokens and over_limit (more tokens than `limit`)."""
    added = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    names = [n for n, _ in added]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    ins = docs.select(*dict.fromkeys([*keep, text_column]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in in_chunks(batches, text_column, CHUNK_BYTES):
            texts = [t or "" for t in batch.column(text_column).to_pylist()]
            tokens = [count(t) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            columns = [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *columns], names=[*keep, *names])

    return ins.mapInArrow(run, T.StructType([*(ins.schema[c] for c in keep), *(T.StructField(n, k) for n, k in added)]))
