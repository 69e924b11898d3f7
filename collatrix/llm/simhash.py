"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits, one a majority over the XXH64 values of the text's word shingles. Two that differ in at most
three bits differ in at most one bit in one of their halves, so each half is covered by itself: anchors are the words
of the perfect Hamming code on 31 bits, with the last bit free, so every half lies within radius 1 of its home anchor.
A fingerprint stands at home, and is replicated to every anchor within radius plus threshold, 1 + 1, of its half (17 at
most). Whatever lies within the threshold of x is then at x's home, and the two are compared there.

Equal fingerprints are one node from the start, so a group of exact copies takes one row however large it is. A large
group at an anchor yields a spanning forest of its links rather than all of them, and links between fingerprints that
share a home are made before any is replicated. An anchor that a sample of the fingerprints shows to be hot is split by
anchors of its own on the other half's quarters, one of which differs in at most one bit as well, so no anchor gathers a
great part of the fingerprints in one task. Pairs that compare as near are contracted to components in rounds, on
checkpoints.

Defined results: null and empty texts have no shingle and the fingerprint zero, and link like any other; repeated
rows and ids fall together; a null id never names a component unless its component has no other; an empty table gives
an empty result. Other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_intdigest, xxh64_intdigest

from .common import checkpointed, giving_back, in_chunks, mix64, ragged

CHUNK_BYTES = 1 << 20
SPREAD_ROWS = 1_000
#: Links (of 16 bytes) that one task joins when rounds have left no more.
LAST_LINKS = 1 << 20
#: Groups of more rows than this yield a forest of their links, smaller ones all their links.
LARGE_GROUP = 64
#: (first bit, bits under a Hamming code, free bits)
Section = tuple[int, int, int]
THRESHOLD = 3
HALVES: tuple[Section, ...] = ((0, 31, 1), (32, 31, 1))
#: One fingerprint in this many is looked at for hot anchors, which have this many of those; at most so many are split.
SAMPLE, HOT, MOST_HOT = 64, 256, 1 << 16
#: A byte of the unpacked bits holds a count up to this.
LANE = 255


def shingle_pieces(texts: list[str | None], shingle: int) -> tuple[list[bytes], np.ndarray]:
    """The shingles of whole texts, repeats included, one text after another, and how many each text has."""
    pieces: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not own:
            continue
        line = b" ".join(own)
        ends = np.cumsum([len(w) + 1 for w in own]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        found = [line[a:b] for a, b in zip(starts, ends[min(shingle, len(own)) - 1 :].tolist())]
        counts[i] = len(found)
        pieces += found
    return pieces, counts


def majorities(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from the hashes (rows of words of 64 bits) of its shingles."""
    words = h.shape[1]
    out = np.zeros((len(counts), words), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.cumsum(counts[full]) - counts[full]
    cuts = np.unique(np.concatenate([starts, *(s + np.arange(LANE, n, LANE) for s, n in zip(starts, counts[full]) if n > LANE)]))
    # Eight counts of a byte each are added as one integer; no lane runs over within LANE rows.
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little").view(np.uint64)
    lanes = np.add.reduceat(bits, cuts, axis=0).view(np.uint8).reshape(-1, 64 * words).astype(np.int64)
    sums = np.add.reduceat(lanes, np.searchsorted(cuts, starts), axis=0)
    set_bits = (2 * sums > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).reshape(-1, words)
    return out


def fingerprints(texts: list[str | None], shingle: int = 3, words: int = 1, seed: int = 42) -> np.ndarray:
    """The fingerprints of whole texts, `words` columns of 64 bits: the first from XXH64, two more from XXH3's 128."""
    pieces, counts = shingle_pieces(texts, shingle)
    h = np.empty((len(pieces), words), np.uint64)
    h[:, 0] = [xxh64_intdigest(x, seed) for x in pieces]
    if words > 1:
        h[:, 1:] = np.frombuffer(b"".join(xxh3_128_intdigest(x, seed).to_bytes(16, "little") for x in pieces), "<u8").reshape(-1, 2)
    return majorities(h, counts)


def with_fingerprints(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, shingle: int = 3, names: Sequence[str] = ("fp",)) -> DataFrame:
    """The `keep` columns and the fingerprint as signed bigints, one for each of `names` (one or three)."""
    names = list(names)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    ins = docs.select(*dict.fromkeys([*keep, text_column]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, text_column, CHUNK_BYTES):
            found = fingerprints(batch.column(text_column).to_pylist(), shingle, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *(pa.array(found[:, i]) for i in range(len(names)))], names=[*keep, *names])

    return ins.mapInArrow(giving_back(run), T.StructType([*(ins.schema[c] for c in keep), *(T.StructField(n, T.LongType()) for n in names)]))


def syndromes(part: np.ndarray, code: int) -> np.ndarray:
    """Which of the bits 1 to `code` to flip for the nearest code word, 0 for none. Bits are numbered from 1."""
    out = np.zeros(len(part), np.int64)
    for i in range(1, code + 1):
        out ^= np.where((part >> (i - 1)) & 1, i, 0)
    return out


def anchors(fps: np.ndarray, sections: Sequence[Section], home_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, anchor key, whether it is the home) for every anchor within 2 of each section, or the homes."""
    index, key, home = [], [], []
    every = np.arange(len(fps))
    for number, (offset, code, free) in enumerate(sections):
        size = code + free
        word, shift = divmod(offset, 64)
        part = fps[:, word] >> np.uint64(shift)
        if shift + size > 64:
            part = part | (fps[:, word + 1] << np.uint64(64 - shift))
        part = (part & np.uint64((1 << size) - 1)).astype(np.int64)
        s = syndromes(part, code)
        nearest = part ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)

        def put(at: np.ndarray, anchor: np.ndarray, is_home: bool) -> None:
            index.append(at)
            key.append(anchor | (number << 48))
            home.append(np.full(len(at), is_home))

        put(every, nearest, True)
        if home_only:
            continue
        for i in range(code, size):
            put(every, nearest ^ (1 << i), False)
        words = every[s == 0]
        for i in range(code, size):
            for j in range(i + 1, size):
                put(words, nearest[words] ^ (1 << i) ^ (1 << j), False)
        for i in range(1, code + 1):
            j = s ^ i
            at = every[(s > 0) & (j > i)]
            put(at, part[at] ^ (1 << (i - 1)) ^ (1 << (j[at] - 1)), False)
    return np.concatenate(index), np.concatenate(key), np.concatenate(home)


def quarters(section: int) -> tuple[Section, ...]:
    """The sections that split a hot anchor of one half: the quarters of the other."""
    first = HALVES[1 - section][0]
    return ((first, 15, 1), (first + 16, 15, 1))


def split_hot(fps: np.ndarray, index: np.ndarray, key: np.ndarray, home: np.ndarray, hot: np.ndarray, home_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of `anchors`, with rows at hot anchors dealt out to anchors of the other half's quarters. A pair that
    meets at a hot anchor, one of it at home, meets at one of these, that one at home there too."""
    at = np.isin(key, hot)
    if not at.any():
        return index, key, home
    found = [(index[~at], key[~at], home[~at])]
    for section in range(len(HALVES)):
        rows = np.flatnonzero(at & (key >> 48 == section))
        sub, sub_key, sub_home = anchors(fps[index[rows]], quarters(section), home_only)
        both = mix64(mix64(key[rows[sub]].view(np.uint64)) ^ sub_key.view(np.uint64)) >> np.uint64(2)
        found.append((index[rows[sub]], both.view(np.int64), home[rows[sub]] & sub_home))
    return tuple(np.concatenate(x) for x in zip(*found))


def forest(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect exactly what the pairs within `threshold` connect, one less than nodes at most.

    Breadth first: each node reached is compared with those that are not yet, so a dense group costs little.
    """
    left, a, b = np.arange(len(fps)), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]).sum(axis=1) <= threshold
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue += found.tolist()
                left = left[~near]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def compare_anchors(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray, label: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of differing labels within `threshold`, for rows in the order of whole anchors: those at home against
    all of their anchor, or in large groups a forest of the links."""
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[first, len(anchor)])
    homes = np.add.reduceat(home.astype(np.int64), first)
    mixed = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
    large = (size > LARGE_GROUP) & (homes > 0) & mixed
    row_group = np.repeat(np.arange(len(first)), size)
    rows = np.flatnonzero(home & (mixed & ~large)[row_group])
    a = np.repeat(rows, size[row_group[rows]])
    b = ragged(first[row_group[rows]], size[row_group[rows]])
    apart = label[a] != label[b]
    a, b = a[apart], b[apart]
    near = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1) <= threshold
    found_a, found_b = [a[near]], [b[near]]
    for g in np.flatnonzero(large):
        x, y = forest(fps[first[g] : first[g] + size[g]], threshold)
        x, y = x + first[g], y + first[g]
        apart = label[x] != label[y]
        found_a.append(x[apart])
        found_b.append(y[apart])
    return np.concatenate(found_a), np.concatenate(found_b)


def node_numbers(fps: np.ndarray) -> np.ndarray:
    """A 64-bit number for each fingerprint: itself if it has one word."""
    node = fps[:, 0].copy()
    for i in range(1, fps.shape[1]):
        node = mix64(node) ^ fps[:, i]
    return node.view(np.int64)


def near_pairs(nodes: DataFrame, words: Sequence[str], sections: Sequence[Section], threshold: int, home_only: bool = False, ends: str = "label") -> DataFrame:
    """Pairs (a, b) of `ends` that connect what fingerprints within `threshold` at a common anchor connect.

    `nodes` has the words and a label for each fingerprint; links inside one label are known and left out. What a pair
    names is the column `ends`: the labels, or a number of each fingerprint.
    """
    words = list(words)
    numbers = list(dict.fromkeys(["label", ends]))

    def stacked(data: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.stack([data.column(w).to_numpy() for w in words], axis=1).view(np.uint64)

    def homes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(anchors(stacked(batch), sections, True)[1])], names=["anchor"])

    sampled = nodes.where(F.pmod(F.xxhash64(F.lit(SAMPLE), *words), F.lit(SAMPLE)) == 0).select(*words).mapInArrow(giving_back(homes), "anchor long")
    hot = None
    if tuple(sections) == HALVES and len(words) == 1:
        often = sampled.groupBy("anchor").count().where(F.col("count") >= HOT).orderBy(F.desc("count"), "anchor").limit(MOST_HOT)
        hot = nodes.sparkSession.sparkContext.broadcast(np.sort(often.select("anchor").toArrow().column("anchor").to_numpy()))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SPREAD_ROWS):
                own = batch.slice(start, SPREAD_ROWS)
                fps = stacked(own)
                index, key, home = anchors(fps, sections, home_only)
                if hot is not None:
                    index, key, home = split_hot(fps, index, key, home, hot.value, home_only)
                columns = [pa.array(key << 1 | home), *(pa.array(own.column(c).to_numpy()[index]) for c in numbers), *(pa.array(fps[index, i].view(np.int64)) for i in range(len(words)))]
                yield pa.RecordBatch.from_arrays(columns, names=["place", *numbers, *words])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows > 1:
                place, label = table.column("place").to_numpy(), table.column("label").to_numpy()
                a, b = compare_anchors(place >> 1, stacked(table), (place & 1).astype(bool), label, threshold)
                end = table.column(ends).to_numpy()
                pairs = np.unique(np.stack([np.minimum(end[a], end[b]), np.maximum(end[a], end[b])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("place").to_numpy() >> 1
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut or (held and held[-1].column("place")[-1].as_py() >> 1 != anchor[0]):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    shape = ", ".join(f"{w} long" for w in [*numbers, *words])
    rows = nodes.select(*numbers, *words).mapInArrow(giving_back(spread), f"place long, {shape}")
    dealt = rows.repartition(F.shiftright("place", 1)).sortWithinPartitions("place")
    return dealt.mapInArrow(giving_back(compare), "a long, b long").distinct()


def connect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to) for every node of all links (a, b) of a task: `to` is the least node that is connected."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    links = pa.Table.from_batches(held)
    ends = np.stack([links.column(c).to_numpy() for c in ("a", "b")])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(ends.shape)
    to = np.arange(len(nodes))
    while len(a):
        low = np.minimum(to[a], to[b])
        np.minimum.at(to, to[a], low)
        np.minimum.at(to, to[b], low)
        while not np.array_equal(to, to[to]):
            to = to[to]
        apart = to[a] != to[b]
        a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[to])], names=["node", "to"])


def components(pairs: DataFrame, last_links: int = LAST_LINKS) -> DataFrame:
    """(node, label) for every node in `pairs` (a, b): nodes have equal labels if and only if they are connected.

    Rounds of contraction: a node goes to its least neighbour, if that is less than itself, and on to where that went;
    links follow their ends, and those that fall on one node go. What is less is drawn anew by a hash in each round, so
    that chains shrink by a share of their length. A map of nodes keeps connected what was. Links shrink from round to
    round, and no node's neighbours are gathered; when no more than `last_links` are left, one task joins their ends.
    """
    links = checkpointed(pairs.select("a", "b"))
    labels = None
    turn = 0
    while (left := links.count()) > 0:
        turn += 1
        if left <= last_links:
            moved = checkpointed(links.repartition(1).mapInArrow(giving_back(connect), "node long, to long"))
            links = links.limit(0)
        else:
            both = links.union(links.select("b", "a")).toDF("node", "other")
            drawn = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("rank"), F.col(c).alias("to"))
            hooked = both.groupBy("node").agg(F.least(drawn("node"), F.min(drawn("other")))["to"].alias("up"))
            above = hooked.toDF("up", "top")
            moved = checkpointed(hooked.join(above, "up").select("node", F.col("top").alias("to")))
            ends = links.join(moved.toDF("a", "x"), "a").join(moved.toDF("b", "y"), "b")
            links = checkpointed(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        labels = moved.toDF("node", "label") if labels is None else checkpointed(labels.join(moved.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    return links.toDF("node", "label") if labels is None else labels


def near_groups(marked: DataFrame, words: Sequence[str] = ("fp",), sections: Sequence[Section] = HALVES, threshold: int = THRESHOLD, id_column: str = "doc_id") -> DataFrame:
    """(words, component_id, least_id) for every distinct fingerprint of `marked` (id, words)."""
    words = list(words)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.stack([batch.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node_numbers(fps))], names=[*batch.schema.names, "label"])

    distinct = marked.groupBy(*words).agg(F.min(id_column).alias("least_id"))
    nodes = checkpointed(distinct.mapInArrow(number, T.StructType([*distinct.schema.fields, T.StructField("label", T.LongType())])))
    # Most near copies share a home. These links come first, from one row a section, so that the replicas of a large
    # group find its members under one label already and add next to nothing.
    for home_only in (True, False):
        joined = components(near_pairs(nodes, words, sections, threshold, home_only)).toDF("label", "root")
        nodes = checkpointed(nodes.join(joined, "label", "left").select(*words, "least_id", F.coalesce("root", "label").alias("label")))
    named = nodes.groupBy("label").agg(F.min("least_id").alias("component_id"))
    return nodes.join(named, "label").select(*words, "component_id", "least_id")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row."""
    marked = checkpointed(with_fingerprints(docs, text_column, [id_column], shingle))
    return marked.join(near_groups(marked, id_column=id_column).drop("least_id"), "fp").select(id_column, "fp", "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5) -> DataFrame:
    """`docs` with the row of least id of each group of near copies: see `near_copies.one_of_each`."""
    from .near_copies import one_of_each

    return one_of_each(docs, id_column, text_column, shingle)


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
