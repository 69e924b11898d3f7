"""Quality rules on repetition, from a suffix array over the words of each document.

A batch of documents is one sequence of word numbers. Each document has numbers of its own, so no match crosses
documents. Suffixes are sorted by prefix doubling: at each level only groups that still have two members are sorted
again. The longest common prefix of neighbours comes from the ranks of the levels, longest step first. Each interval
of neighbours with a common prefix of `min_words` or more is a maximal repeated substring; the spans of all its
occurrences are united, and a document is rejected if they cover more than `most_covered` of its words or if the
longest has more than `most_repeat` words.

Defined results: null and empty texts have no words and fail the base rules; repeated rows and equal ids are judged
row by row; no text is cut. Result columns replace columns of the input that have their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SPACE_BYTES, giving_back, in_chunks

#: Characters that count as symbols.
SYMBOL_BYTES = b"#*$%&|<>"
MIN_WORDS, MOST_COVERED, MOST_REPEAT = 12, 0.3, 120
CHUNK_BYTES = 2 << 20

METRICS = (
    ("n_words", pa.int64(), T.LongType()),
    ("word_chars", pa.int64(), T.LongType()),
    ("n_symbols", pa.int64(), T.LongType()),
    ("n_dup_lines", pa.int64(), T.LongType()),
    ("n_repeat_words", pa.int64(), T.LongType()),
    ("n_covered_words", pa.int64(), T.LongType()),
    ("longest_repeat", pa.int64(), T.LongType()),
    ("base_failed", pa.bool_(), T.BooleanType()),
    ("kept", pa.bool_(), T.BooleanType()),
)


def suffix_levels(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of `ids`, and the ranks by the first 1, 2, 4, … items (a rank is its group's first place)."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    levels, step = [rank], 1
    sizes = np.bincount(rank, minlength=n)
    active = np.flatnonzero(sizes[rank] > 1)
    while len(active):
        ahead = active + step
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = (rank[active] << 32) | after
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        same = np.r_[False, key[1:] == key[:-1]]
        own = key >> 32
        group = np.r_[False, own[1:] == own[:-1]]
        place = np.arange(len(key))
        new = own + np.maximum.accumulate(np.where(same, 0, place)) - np.maximum.accumulate(np.where(group, 0, place))
        rank = rank.copy()
        rank[active] = new
        levels.append(rank)
        step *= 2
        sizes = np.bincount(new, minlength=1)
        active = active[sizes[new] > 1]
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    return suffixes, levels


def common_prefixes(suffixes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[k]: items that the suffixes at places k - 1 and k have in common; lcp[0] = 0."""
    n = len(suffixes)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    pairs = np.flatnonzero(levels[0][suffixes[:-1]] == levels[0][suffixes[1:]])
    a, b = suffixes[pairs].copy(), suffixes[pairs + 1].copy()
    shared = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        hit = np.zeros(len(a), bool)
        hit[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        a[hit] += 1 << k
        b[hit] += 1 << k
        shared[hit] += 1 << k
    lcp[pairs + 1] = shared
    return lcp


def repeats(words: list[list[bytes]], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document: words in windows of three that recur, words in repeats of min_words or more, longest repeat."""
    lengths = np.array([len(w) for w in words], np.int64)
    docs = len(words)
    n = int(lengths.sum()) + docs
    ids = np.empty(n, np.int64)
    start = used = 0
    for own in words:
        number: dict[bytes, int] = {}
        ids[start : start + len(own)] = [number.setdefault(w, len(number)) for w in own]
        ids[start : start + len(own)] += used
        used += len(number) + 1
        start += len(own) + 1
        ids[start - 1] = used - 1
    suffixes, levels = suffix_levels(ids)
    lcp = common_prefixes(suffixes, levels)
    longest_here = np.zeros(n, np.int64)
    longest_here[suffixes] = np.maximum(lcp, np.r_[lcp[1:], 0])
    owner = np.repeat(np.arange(docs), lengths + 1)

    def covered(at: np.ndarray, span: np.ndarray) -> np.ndarray:
        edges = np.bincount(at, minlength=n + 1) - np.bincount(at + span, minlength=n + 1)
        return np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=docs)

    threes, long_ones = np.flatnonzero(longest_here >= 3), np.flatnonzero(longest_here >= min_words)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, owner, longest_here)
    return covered(threes, np.full(len(threes), 3)), covered(long_ones, longest_here[long_ones]), longest


def judge(texts: list[str | None], min_words: int = MIN_WORDS, most_covered: float = MOST_COVERED, most_repeat: int = MOST_REPEAT) -> dict[str, np.ndarray]:
    """The metrics and the verdict for each text."""
    texts = [t or "" for t in texts]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = [b.split() for b in raw]
    n_words = np.array([len(w) for w in words], np.int64)
    word_chars = np.array([len(t) - len(b) + len(b.translate(None, SPACE_BYTES)) for t, b in zip(texts, raw)], np.int64)
    symbols = np.array([len(b) - len(b.translate(None, SYMBOL_BYTES)) for b in raw], np.int64)
    dup_lines = np.zeros(len(texts), np.int64)
    for i, b in enumerate(raw):
        lines = [x for x in b.split(b"\n") if x.strip(SPACE_BYTES)]
        dup_lines[i] = len(lines) - len(set(lines))
    if texts:
        repeat_words, covered, longest = repeats(words, min_words)
    else:
        repeat_words = covered = longest = n_words
    failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    kept = ~failed & (covered <= most_covered * n_words) & (longest <= most_repeat)
    return dict(zip((m[0] for m in METRICS), (n_words, word_chars, symbols, dup_lines, repeat_words, covered, longest, failed, kept)))


def apply_rules(
    docs: DataFrame,
    text_column: str = "text",
    keep: list[str] | None = None,
    only_kept: bool = False,
    min_words: int = MIN_WORDS,
    most_covered: float = MOST_COVERED,
    most_repeat: int = MOST_REPEAT,
) -> DataFrame:
    """The `keep` columns of every document with its metrics and verdict; with `only_kept`, the kept rows as they came."""
    names = [m[0] for m in METRICS]
    keep = [c for c in (docs.columns if keep is None else keep) if only_kept or c not in names]
    ins = docs.select(*dict.fromkeys([*keep, text_column]))
    fields = [ins.schema[c] for c in keep]
    schema = T.StructType(fields + ([] if only_kept else [T.StructField(m[0], m[2]) for m in METRICS]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, text_column, CHUNK_BYTES):
            found = judge(batch.column(text_column).to_pylist(), min_words, most_covered, most_repeat)
            own = batch.select(keep)
            if only_kept:
                yield own.filter(pa.array(found["kept"]))
            else:
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(found[m[0]], m[1]) for m in METRICS)], names=[*keep, *names])

    return ins.mapInArrow(giving_back(run), schema)
