"""Removal of repeated byte strings, by deep-shallow sorting of the suffixes that can repeat.

A byte goes if a string of `length` bytes that covers it also starts earlier, in a document with a smaller id or
earlier in the same one. Sorting every suffix of a corpus would move it hundreds of times over, so suffixes are first
dealt out by anchors. The anchor of a window of `length` bytes is its leftmost least-hashed substring of GRAM bytes:
equal windows have equal anchors at equal places, and neighbouring windows share one, so a document has an anchor for
every 35 bytes or so. The windows of an anchor make a segment.

1. Scan: each task keeps the first of its equal segments, marks the others, and ships the first as a few numbers.
2. Buckets by anchor hash: of segments that are equal, all but the first are marked. Where one anchor has differing
   segments, their windows may be equal in part, and these go on with their text.
3. Sort: the suffixes that start at these windows are sorted by multikey quicksort on words of eight bytes down to
   SHALLOW bytes; groups still equal go to blind tries, whose nodes hold only how far to skip and the byte to branch
   on. Runs with a common prefix of `length` bytes mark all but their first.
4. Marks are united for each document, and the other bytes are kept.

An anchor with very many differing segments (a short passage that much of the corpus shares) would fill one bucket: its
windows are dealt out one by one by their own hash, after each task has kept only the first of its equal ones.
Equality in steps 1 and 2 is equality of two 64-bit hashes with length; step 3 compares the bytes.

Defined results: null and empty texts have no bytes; matches never cross documents; repeated rows, and other rows of
one id, count as one document, so of two rows with the same id the later start goes and equal starts both stay; a null
id comes before all others; texts shorter than `length` stay whole. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, giving_back, in_chunks, mix64, ragged, renamed

LENGTH, GRAM = 100, 32
#: Depth in bytes of the multikey quicksort.
SHALLOW = 24
#: Bytes hashed at once, anchors that a scan task holds before it ships them, bytes of text that a bucket or partition stands for.
BLOCK, HELD, BUCKET_BYTES, PART_BYTES = 1 << 17, 1 << 17, 8 << 20, 16 << 20
#: Rows compared at once in the tries.
COMPARED = 1 << 15
#: Segments of one anchor beyond which their windows are dealt out one by one.
HOT_SEGMENTS = 2048
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
RECORD = np.dtype([("h", "<u8"), ("s", "<u8"), ("doc", "<u4"), ("lo", "<i4"), ("left", "u1"), ("more", "u1")])
NO_ID = -(1 << 63)


class Hasher:
    """Polynomial hashes of substrings of one block, modulo 2^64."""

    powers = inverses = table = None

    def __init__(self, block: np.ndarray) -> None:
        n = len(block)
        if Hasher.powers is None or len(Hasher.powers) < n + 1:
            size = max(n + 1, BLOCK + 2 * LENGTH)
            with np.errstate(over="ignore"):
                Hasher.powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE)])
                Hasher.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(pow(int(BASE), -1, 1 << 64)))])
                Hasher.table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(Hasher.table[block] * Hasher.powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * Hasher.inverses[start] + (end - start).astype(np.uint64))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, from minima to the left and right inside blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def segments_of(block: np.ndarray, valid: np.ndarray) -> tuple[Hasher, np.ndarray, np.ndarray, np.ndarray]:
    """(hasher, anchor, first window, last window) of each segment; `valid` says which windows lie in one document."""
    hasher = Hasher(block)
    at = np.arange(len(block) - GRAM + 1)
    key = (hasher.of(at, at + GRAM) & np.uint64(~((1 << 21) - 1) & ((1 << 64) - 1))) | at.astype(np.uint64)
    anchor = (least_in_windows(key, LENGTH - GRAM + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
    windows = np.flatnonzero(valid)
    anchor = anchor[windows]
    if not len(windows):
        return hasher, anchor, windows, windows
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(windows)] - 1
    return hasher, anchor[first], windows[first], windows[last]


def blocks_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, valid windows, document of each byte, start of the block in it): many short texts, or a stretch of one."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def put() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(b) for _, _, b in held])
        block = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
        within = np.arange(len(block)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        valid = (within + LENGTH <= np.repeat(lengths, lengths))[: len(block) - LENGTH + 1]
        return block, valid, np.repeat([d for d, _, _ in held], lengths), within + np.repeat([s for _, s, _ in held], lengths)

    for d, text in enumerate(texts):
        for start in range(0, len(text) - LENGTH + 1, BLOCK):
            piece = text[start : start + BLOCK + LENGTH - 1]
            if held and size + len(piece) > BLOCK + LENGTH:
                yield put()
                held, size = [], 0
            held.append((d, start, piece))
            size += len(piece)
    if held:
        yield put()


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Disjoint spans, in order, that cover what the given ones cover; spans that touch become one."""
    if not len(starts):
        return np.zeros((0, 2), np.int32)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return np.stack([starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]], axis=1).astype(np.int32)


def mark_rows(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """Rows (id, key, spans) of the marks; `doc` indexes ids and keys."""
    order = np.argsort(doc, kind="stable")
    doc, starts, ends = doc[order], starts[order], ends[order]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
    cuts = [*first, len(doc)]
    return [(int(ids[doc[a]]), int(keys[doc[a]]), merged(starts[a:b], ends[a:b]).tobytes()) for a, b in zip(cuts, cuts[1:])]


def not_first(groups: tuple[np.ndarray, ...], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of groups and then of id and start, whether an equal row has an earlier id or start)."""
    order = np.lexsort((starts, ids, *groups))
    same = np.ones(max(len(order) - 1, 0), bool)
    for g in groups:
        same &= g[order][1:] == g[order][:-1]
    place = np.arange(len(order))
    head = np.maximum.accumulate(np.where(np.r_[True, ~same][: len(order)], place, 0)) if len(order) else place
    lead = order[head]
    return order, (ids[order] != ids[lead]) | (starts[order] != starts[lead])


def packed(records: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> bytes:
    docs, index = np.unique(records["doc"], return_inverse=True)
    records = records.copy()
    records["doc"] = index
    return np.array([len(docs)], "<i8").tobytes() + ids[docs].astype("<i8").tobytes() + keys[docs].astype("<i8").tobytes() + records.tobytes()


def unpacked(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(records, ids, keys), with `doc` counted over all payloads."""
    records, ids, keys, base = [], [], [], 0
    for p in payloads:
        n = int(np.frombuffer(p, "<i8", 1)[0])
        ids.append(np.frombuffer(p, "<i8", n, 8))
        keys.append(np.frombuffer(p, "<i8", n, 8 + 8 * n))
        own = np.frombuffer(p, RECORD, offset=8 + 16 * n).copy()
        own["doc"] += base
        base += n
        records.append(own)
    return np.concatenate(records), np.concatenate(ids), np.concatenate(keys)


# ---------------------------------------------------------------------------------------------- 1. scan

ROW = "bucket int, id long, key long, spans binary, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "id", "key", "spans", "payload"])


def spread_marks(marks: list[tuple], buckets: int) -> list[tuple]:
    return [(key % buckets, id_, key, spans, None) for id_, key, spans in marks]


def scanner(buckets: int):
    def ship(held: list[np.ndarray], ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = np.concatenate(held)
        order, later = not_first((records["s"], records["h"]), ids[records["doc"]], records["lo"])
        gone, records = records[order[later]], records[order[~later]]
        yield _rows(spread_marks(mark_rows(ids, keys, gone["doc"], gone["lo"], gone["lo"] + gone["more"].astype(np.int32) + LENGTH), buckets))
        bucket = (records["h"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        records, bucket = records[order], bucket[order]
        cuts = [*np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(records)] if len(records) else [0]
        yield _rows([(int(bucket[a]), None, None, None, packed(records[a:b], ids, keys)) for a, b in zip(cuts, cuts[1:])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, ids, keys = [], 0, [], []
        base = 0
        for batch in in_chunks(batches, "text", BLOCK * 4):
            ids.append(batch.column("id").to_numpy(zero_copy_only=False))
            keys.append(batch.column("key").to_numpy(zero_copy_only=False))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for block, valid, doc, within in blocks_of(texts):
                hasher, anchor, lo, hi = segments_of(block, valid)
                found = np.empty(len(anchor), RECORD)
                found["h"] = hasher.of(anchor, anchor + GRAM)
                found["s"] = hasher.of(lo, hi + LENGTH)
                found["doc"], found["lo"] = doc[lo] + base, within[lo]
                found["left"], found["more"] = anchor - lo, hi - lo
                held.append(found)
                count += len(found)
            base += batch.num_rows
            if count > HELD:
                yield from ship(held, np.concatenate(ids), np.concatenate(keys))
                held, count, ids, keys, base = [], 0, [], [], 0
                give_back()
        if held:
            yield from ship(held, np.concatenate(ids), np.concatenate(keys))

    return run


# ---------------------------------------------------------------------------------------------- 2. buckets

def join_bucket(table: pa.Table, hot_segments: int = HOT_SEGMENTS) -> pa.Table:
    """Marks of this bucket as they are and new ones, and for each document the segments that go on (payload)."""
    marks = table.filter(pc.is_valid(table["spans"])).select(["id", "key", "spans"])
    out = [(0, i, k, s, None) for i, k, s in zip(*(c.to_pylist() for c in marks.columns))]
    payloads = [p for p in table["payload"].to_pylist() if p is not None]
    if payloads:
        records, ids, keys = unpacked(payloads)
        order, later = not_first((records["s"], records["h"]), ids[records["doc"]], records["lo"])
        gone = records[order[later]]
        out += [(0, *m, None) for m in mark_rows(ids, keys, gone["doc"], gone["lo"], gone["lo"] + gone["more"].astype(np.int32) + LENGTH)]
        first = records[order[~later]]
        size = np.diff(np.r_[starts := np.flatnonzero(np.r_[True, first["h"][1:] != first["h"][:-1]]), len(first)])
        # Rows of one id at one place are all first; what differs is counted by content.
        kinds = np.add.reduceat(np.r_[1, (first["s"][1:] != first["s"][:-1]) | (first["h"][1:] != first["h"][:-1])], starts)
        many = np.repeat(kinds, size)
        # `more` and `left` fit in seven bits; the eighth of `left` says that the anchor is hot.
        first["left"] |= np.where(many > hot_segments, 128, 0).astype(np.uint8)
        on = first[many > 1]
        on = on[np.argsort(on["doc"], kind="stable")]
        cuts = [*np.flatnonzero(np.r_[True, on["doc"][1:] != on["doc"][:-1]]), len(on)] if len(on) else [0]
        out += [(0, int(ids[on["doc"][a]]), int(keys[on["doc"][a]]), None, on[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
    return pa.Table.from_batches([_rows(out)])


def bucket_joiner(hot_segments: int):
    def run(table: pa.Table) -> pa.Table:
        found = join_bucket(table, hot_segments)
        give_back()
        return found

    return run


# ---------------------------------------------------------------------------------------------- 3. sort

SEGMENT = "bucket int, id long, key long, spans binary, lo int, bytes binary"


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "id", "key", "spans", "lo", "bytes"])


def cutter(buckets: int, text_column: str):
    """The text of each segment; of hot anchors each window, the first of equal ones. Marks so far pass through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: list[tuple[int, int, int, int, bytes]] = []

        def ship() -> Iterator[pa.RecordBatch]:
            value = np.array([x[0] for x in hot], np.uint64)
            ids, keys, lo = (np.array([x[i] for x in hot], np.int64) for i in (1, 2, 3))
            order, later = not_first((value,), ids, lo)
            gone = order[later]
            docs, index = np.unique(np.stack([ids[gone], keys[gone]], axis=1), axis=0, return_inverse=True)
            yield _segments([(m[1] % buckets, *m, None, None) for m in mark_rows(docs[:, 0], docs[:, 1], index.ravel(), lo[gone], lo[gone] + LENGTH)])
            yield _segments([(int(hot[i][0] % buckets), hot[i][1], hot[i][2], None, hot[i][3], hot[i][4]) for i in order[~later]])

        for batch in in_chunks(batches, text_column, 4 * BLOCK):
            rows = []
            for id_, key, text, payloads, chunks in zip(*(batch.column(c).to_pylist() for c in ("_id", "_key", text_column, "_payloads", "_chunks"))):
                if chunks:
                    rows.append((key % buckets, id_, key, spans_of(chunks).tobytes(), None, None))
                raw = text.encode("utf-8", "surrogatepass") if payloads else b""
                for record in np.frombuffer(b"".join(payloads), RECORD):
                    lo, end = int(record["lo"]), int(record["lo"]) + int(record["more"]) + LENGTH
                    if record["left"] & 128:
                        hasher = Hasher(np.frombuffer(raw[lo:end], np.uint8))
                        at = np.arange(end - lo - LENGTH + 1)
                        hot += [(v, id_, key, lo + i, raw[lo + i : lo + i + LENGTH]) for i, v in enumerate(hasher.of(at, at + LENGTH).tolist())]
                    else:
                        rows.append((int(record["h"]) % buckets, id_, key, None, lo, raw[lo:end]))
            yield _segments(rows)
            if len(hot) > HELD // 4:
                yield from ship()
                hot.clear()
        if hot:
            yield from ship()

    return run


def multikey_order(windows: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort on words of eight bytes: (order, first place of each row's group at this depth).

    Rows are byte strings of equal length, `windows[start]`, which is never made as a whole. At each word only rows whose
    group has two members or more are sorted.
    """
    n = len(start)
    order, group = np.arange(n), np.zeros(n, np.int64)
    active = np.arange(n)
    for at in range(0, depth, 8):
        if not len(active):
            break
        rows = order[active]
        word = np.ascontiguousarray(windows[start[rows], at : at + 8]).view(">u8").ravel().astype(np.uint64)
        sub = np.lexsort((word, group[active]))
        order[active], word = rows[sub], word[sub]
        own = group[active]
        new = np.r_[True, (own[1:] != own[:-1]) | (word[1:] != word[:-1])]
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        size = np.diff(np.r_[np.flatnonzero(new), len(active)])
        active = active[np.repeat(size, size) > 1]
    return order, group


def blind_tries(windows: np.ndarray, start: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Orders the rows inside each group by blind tries, all groups a level at a time; returns the groups of equal rows.

    A node skips to the first byte at which its rows differ from its first row, and branches on that byte alone. A
    node whose rows don't differ is a leaf. `order` is changed in place.
    """
    n = len(order)
    size = np.bincount(group, minlength=n)
    active = np.flatnonzero(size[group] > 1)
    while len(active):
        own = group[active]
        rows, lead = order[active], order[own]
        first = np.empty(len(active), np.int64)
        for k in range(0, len(active), COMPARED):
            some = slice(k, k + COMPARED)
            differs = windows[start[rows[some]], depth:] != windows[start[lead[some]], depth:]
            first[some] = np.where(differs.any(axis=1), differs.argmax(axis=1), windows.shape[1])
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts = np.diff(np.r_[heads, len(own)])
        skip = np.repeat(np.minimum.reduceat(first, heads), counts)
        inner = skip < windows.shape[1]
        active, own, rows, skip = active[inner], own[inner], rows[inner], skip[inner]
        branch = windows[start[rows], depth + skip]
        sub = np.lexsort((branch, own))
        order[active], branch = rows[sub], branch[sub]
        new = np.r_[True, (own[1:] != own[:-1]) | (branch[1:] != branch[:-1])][: len(own)]
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        size = np.diff(np.r_[np.flatnonzero(new), len(active)])
        active = active[np.repeat(size, size) > 1]
    return group


def deep_shallow(windows: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): rows in byte order, and the first place of the run of equal rows that each place belongs to."""
    start = np.arange(len(windows)) if start is None else start
    order, group = multikey_order(windows, start, SHALLOW)
    return order, blind_tries(windows, start, order, group, SHALLOW)


def sort_bucket(table: pa.Table) -> pa.Table:
    marks = table.filter(pc.is_valid(table["spans"])).select(["id", "key", "spans"])
    out = list(zip(*(c.to_pylist() for c in marks.columns)))
    own = table.filter(pc.is_valid(table["bytes"]))
    if own.num_rows:
        texts = own["bytes"].to_pylist()
        lengths = np.array([len(t) for t in texts])
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        counts = lengths - LENGTH + 1
        begin = np.cumsum(lengths) - lengths
        start = ragged(begin, counts)
        segment = np.repeat(np.arange(len(texts)), counts)
        windows = np.lib.stride_tricks.sliding_window_view(buffer, LENGTH)
        ids, keys = own["id"].to_numpy(), own["key"].to_numpy()
        lo = own["lo"].to_numpy()[segment] + start - begin[segment]
        order, group = deep_shallow(windows, start)
        value = np.empty(len(order), np.int64)
        value[order] = group
        rows, later = not_first((value,), ids[segment], lo)
        gone = rows[later]
        out += mark_rows(ids, keys, segment[gone], lo[gone], lo[gone] + LENGTH)
    columns = list(zip(*out)) if out else [(), (), ()]
    made = pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["id", "key", "spans"])
    give_back()
    return made


# ---------------------------------------------------------------------------------------------- 4. result

def spans_of(chunks: list[bytes] | None) -> np.ndarray:
    both = np.frombuffer(b"".join(chunks or []), np.int32).reshape(-1, 2)
    return merged(both[:, 0].astype(np.int64), both[:, 1].astype(np.int64))


def kept_bytes(raw: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def with_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot_segments: int = HOT_SEGMENTS) -> tuple[DataFrame, list[str]]:
    """(every row of `docs` with `_spans`, its repeated spans as packed pairs of 32-bit integers, null if it has none;
    the names that its columns have there)."""
    spark = docs.sparkSession
    columns, own = renamed(docs, docs.columns)
    named = dict(zip(docs.columns, own))
    id_, text = F.coalesce(F.col(named[id_column]).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(named[text_column]), F.lit(""))
    keyed = docs.select(*columns).withColumns({"_id": id_, "_key": F.xxhash64(text)})
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    buckets = max(12, math.ceil(size / BUCKET_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    long_enough = keyed.where(F.octet_length(named[text_column]) >= LENGTH).select(F.col("_id").alias("id"), F.col("_key").alias("key"), F.col(named[text_column]).alias("text"))
    # Both groupings by bucket have as many partitions as the input needs, so that tasks don't grow with it.
    scanned = long_enough.mapInArrow(giving_back(scanner(buckets)), ROW).repartition(parts, "bucket")
    joined = scanned.groupBy("bucket").applyInArrow(bucket_joiner(hot_segments), ROW)
    going_on = joined.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list("payload").alias("_payloads"), F.collect_list("spans").alias("_chunks"))
    # Both joins below read this one exchange: Python takes all its columns, so none is pruned from either.
    dealt = keyed.repartition(parts, "_id", "_key")
    cut = dealt.join(going_on, ["_id", "_key"]).mapInArrow(giving_back(cutter(buckets, named[text_column])), SEGMENT)
    marks = cut.repartition(parts, "bucket").groupBy("bucket").applyInArrow(sort_bucket, "id long, key long, spans binary")
    marks = marks.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list("spans").alias("_spans"))
    return dealt.join(marks, ["_id", "_key"], "left"), own


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    joined, (own_id, own_text) = with_spans(docs.select(id_column, text_column), id_column, text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, own_text, 4 * BLOCK):
            found = []
            for text, chunks in zip(batch.column(own_text).cast(pa.binary()).to_pylist(), batch.column("_spans").to_pylist()):
                spans = spans_of(chunks)
                found.append((len(text or b""), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept_bytes(text or b"", spans)).hexdigest()))
            columns = list(zip(*found)) if found else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(own_id), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return joined.mapInArrow(giving_back(run), f"{id_column} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with repeated spans taken out of the text; bytes of a character that a span cuts go with it."""
    schema = docs.schema
    joined, own = with_spans(docs, id_column, text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, own[schema.names.index(text_column)], 4 * BLOCK):
            columns = dict(zip(schema.names, batch.select(own).columns))
            texts = columns[text_column].to_pylist()
            for i, chunks in enumerate(batch.column("_spans").to_pylist()):
                if chunks:
                    texts[i] = kept_bytes(texts[i].encode(), spans_of(chunks)).decode("utf-8", "ignore")
            columns[text_column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=schema.names)

    return joined.mapInArrow(giving_back(run), schema)
