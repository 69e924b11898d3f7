"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, merged by score.

Vectors are dealt into shards of about `shard_rows` by a hash of their content. A shard's graph is flat arrays: for each
layer a table of neighbours, -1 where there are fewer. Points are inserted in blocks that grow with the graph; a block
searches the graph so far and its own points, links to a spread choice of what it finds, and is linked back, keeping
again a spread choice where a point has too many links. Search goes greedily through the upper layers and then keeps
the best `ef` of the lowest, for a block of queries at a time. Scores are computed anew on the original vectors in
double precision, and each query keeps its k best over all shards.

Equal vectors are one point of a graph, with their k + 1 smallest ids: enough for any answer, however many copies.

The measure is the inner product, in the graph as in the result: a point links to those with which its product is
largest. Recall at 20 on a full shard of 64 components is 0.98 and more on Gaussian vectors, whether their lengths agree
or vary tenfold (tests). A shard of no more than `ef` points is read whole.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or
candidate; vectors of another length than the query's are no candidates for it; ties go to the smaller id; repeated
rows of one id and vector are one candidate; fewer than k candidates are all returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD_ROWS = 8192
LINKS, EF_BUILD, EF_SEARCH = 16, 96, 200
BLOCK = 256


class Graph:
    """layers[l]: (points, links) table of neighbour numbers; `top[i]` is the highest layer of point i."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 5) -> None:
        n = len(vectors)
        # Scaled, as a product of components beyond single precision would not compare.
        self.points = (vectors / max(np.abs(vectors).max(initial=0.0), 1e-300)).astype(np.float32)
        self.links = links
        rng = np.random.default_rng(seed)
        self.top = np.floor(-np.log(1 - rng.random(n)) / np.log(links)).astype(np.int64)
        order = np.argsort(-self.top, kind="stable")  # upper layers first, so that each block finds its entry ready
        self.number = order
        self.points, self.top = self.points[order], self.top[order]
        self.layers = [np.full((int((self.top >= level).sum()), links * (2 if level == 0 else 1)), -1, np.int64) for level in range(int(self.top.max(initial=0)) + 1)]
        for level in range(len(self.layers)):
            self._fill(level, ef)

    def _fill(self, level: int, ef: int) -> None:
        """Links the points of one layer; they are the first len(table) points, the entries of higher ones first."""
        table = self.layers[level]
        n, done = len(table), 0
        while done < n:
            size = min(n - done, max(32, min(BLOCK, done)))
            block = np.arange(done, done + size)
            own = self.points[block] @ self.points[block].T
            np.fill_diagonal(own, -np.inf)
            if done:
                found, score = self._beam(self.points[block], level, np.zeros((size, 1), np.int64), ef, done)
            else:
                found, score = np.zeros((size, 0), np.int64), np.zeros((size, 0), np.float32)
            among = min(size - 1, ef)
            if among:
                best = np.argpartition(-own, among - 1, axis=1)[:, :among]
                found = np.concatenate([found, block[best]], axis=1)
                score = np.concatenate([score, np.take_along_axis(own, best, axis=1)], axis=1)
            table[block, : self.links] = chosen = self._spread(found, score, self.links)
            self._link_back(table, block, chosen)
            done += size

    def _spread(self, found: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """For each row up to `most` candidates, best first, none nearer to one taken than to the row's own point; places
        left over go to the best of the rest."""
        order = np.argsort(-score, axis=1, kind="stable")[:, : 3 * most]
        found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
        rows, width = found.shape
        out = np.full((rows, most), -1, np.int64)
        if not width:
            return out
        vectors = self.points[np.maximum(found, 0)]
        mutual = vectors @ vectors.transpose(0, 2, 1)
        open_ = np.isfinite(score) & (found >= 0)
        taken = np.zeros((rows, width), bool)
        for j in range(width):
            hidden = (taken[:, :j] & (mutual[:, j, :j] > score[:, j, None])).any(axis=1)
            taken[:, j] = open_[:, j] & ~hidden & (taken[:, :j].sum(axis=1) < most)
        rank = np.where(taken, 0, np.where(open_, 1, 2)) * width + np.arange(width)
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        good = np.take_along_axis(open_, pick, 1)
        out[:, : pick.shape[1]] = np.where(good, np.take_along_axis(found, pick, 1), -1)
        return out

    def _link_back(self, table: np.ndarray, block: np.ndarray, chosen: np.ndarray) -> None:
        source = np.repeat(block, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[first, len(target)])
        wide = table.shape[1]
        points = target[first]
        width = wide + int(counts.max(initial=0))
        found = np.full((len(points), width), -1, np.int64)
        found[:, :wide] = table[points]
        found[np.repeat(np.arange(len(points)), counts), wide + np.arange(len(target)) - np.repeat(first, counts)] = source
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[found == points[:, None]] = -1
        few = (found >= 0).sum(axis=1) <= wide
        packed = -np.sort(-found[few], axis=1)[:, :wide]
        table[points[few]] = packed
        many = np.flatnonzero(~few)
        for start in range(0, len(many), BLOCK):
            rows = many[start : start + BLOCK]
            score = np.einsum("rwd,rd->rw", self.points[np.maximum(found[rows], 0)], self.points[points[rows]])
            score[found[rows] < 0] = -np.inf
            table[points[rows]] = self._spread(found[rows], score, wide)

    def _beam(self, queries: np.ndarray, level: int, entry: np.ndarray, ef: int, among: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, scores) of up to ef best in a layer, best first, for a block of queries; only points < `among`."""
        table, count = self.layers[level], len(queries)
        seen = np.zeros((count, among), bool)
        rows = np.arange(count)[:, None]
        seen[rows, entry] = True
        found = np.full((count, ef), -1, np.int64)
        score = np.full((count, ef), -np.inf, np.float32)
        found[:, : entry.shape[1]] = entry
        score[:, : entry.shape[1]] = np.einsum("qed,qd->qe", self.points[entry], queries)
        open_ = found >= 0
        while True:
            best = np.where(open_, score, -np.inf).argmax(axis=1)
            live = np.flatnonzero(open_[np.arange(count), best])
            if not len(live):
                break
            at = best[live]
            open_[live, at] = False
            near = table[found[live, at]]
            fresh = (near >= 0) & (near < among)
            safe = np.where(fresh, near, 0)
            fresh &= ~seen[live[:, None], safe]
            seen[np.broadcast_to(live[:, None], near.shape)[fresh], near[fresh]] = True
            value = np.full(near.shape, -np.inf, np.float32)
            q, j = np.nonzero(fresh)
            value[q, j] = np.einsum("md,md->m", self.points[near[q, j]], queries[live[q]])
            worth = value > score[live, -1][:, None]
            hit = np.flatnonzero(worth.any(axis=1))
            if not len(hit):
                continue
            to = live[hit]
            both = np.concatenate([score[to], np.where(worth[hit], value[hit], -np.inf)], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :ef]
            score[to] = np.take_along_axis(both, order, 1)
            found[to] = np.take_along_axis(np.concatenate([found[to], np.where(worth[hit], near[hit], -1)], axis=1), order, 1)
            open_[to] = np.take_along_axis(np.concatenate([open_[to], worth[hit]], axis=1), order, 1)
        return found, score

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """Numbers of up to `ef` points for each query, -1 where there are fewer."""
        out = np.full((len(queries), ef), -1, np.int64)
        if len(self.points) <= ef:
            out[:, : len(self.points)] = self.number
            return out
        for start in range(0, len(queries), BLOCK):
            own = queries[start : start + BLOCK]
            own = (own / np.maximum(np.abs(own).max(axis=1, initial=0.0), 1e-300)[:, None]).astype(np.float32)
            entry = np.zeros((len(own), 1), np.int64)
            for level in range(len(self.layers) - 1, 0, -1):
                entry = self._beam(own, level, entry, 1, len(self.layers[level]))[0]
            found = self._beam(own, 0, entry, ef, len(self.points))[0]
            out[start : start + BLOCK] = np.where(found >= 0, self.number[np.maximum(found, 0)], -1)
        return out


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector in double precision) of the rows that take part."""
    vector = F.col(vector_column).cast("array<double>")
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))


def collapse(rows: DataFrame, k: int) -> DataFrame:
    """(key, vector as bytes, the k + 1 smallest ids of it): each task first keeps as much of its own rows."""

    def fold(keys: list[bytes], ids: list[list[int]]) -> dict[bytes, list[int]]:
        out: dict[bytes, set[int]] = {}
        for key, some in zip(keys, ids):
            held = out.setdefault(key, set())
            held.update(some)
            if len(held) > 4 * (k + 1):
                out[key] = set(sorted(held)[: k + 1])
        return {key: sorted(held)[: k + 1] for key, held in out.items()}

    names = ["vector", "ids"]

    def made(groups: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(groups), pa.binary()), pa.array(list(groups.values()), pa.list_(pa.int64()))], names=names)

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            flat, cuts = vectors.flatten().to_numpy(zero_copy_only=False) + 0.0, np.r_[0, np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]
            yield made(fold([flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], [[i] for i in batch.column("id").to_pylist()]))

    shape = "vector binary, ids array<long>"
    return rows.mapInArrow(local, shape).groupBy(F.xxhash64("vector").alias("key"), "vector").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids")).select("key", "vector", F.slice("ids", 1, k + 1).alias("ids"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, id, score): for each query row its k nearest rows of `vectors` other than its own id."""
    points = collapse(usable(vectors, id_column, vector_column), k)
    asked = usable(queries, id_column, vector_column).dropDuplicates()
    rows = vectors.count()
    shards = max(1, -(-rows // shard_rows))
    size = F.octet_length("vector")
    # A shard holds vectors of one length; every query is dealt to each shard, which is the search, not a cross join of rows.
    dealt = points.select(F.pmod("key", F.lit(shards)).alias("shard"), size.alias("size"), "vector", "ids")
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), (8 * F.size("vector")).alias("size"), "vector", "id")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            own = np.frombuffer(b"".join(left["vector"].to_pylist()), np.float64).reshape(left.num_rows, -1)
            order = np.lexsort(own.T[::-1])  # the same graph whatever the order of arrival
            own, ids = own[order], [left["ids"][int(i)].as_py() for i in order]
            graph = Graph(own)
            queries_ = np.array(right["vector"].to_pylist(), np.float64)
            found = graph.search(queries_, max(ef, k + 1))
            for q, query_id in enumerate(right["id"].to_pylist()):
                at = found[q][found[q] >= 0]
                score = own[at] @ queries_[q]
                best = np.argsort(-score, kind="stable")
                taken = []
                for b in best:
                    if len(taken) >= k and score[b] < taken[k - 1][0]:
                        break
                    taken += [(float(score[b]), i) for i in ids[at[b]] if i != query_id]
                taken.sort(key=lambda x: (-x[0], x[1]))
                out += [(query_id, i, s) for s, i in taken[:k]]
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    # A task for each shard, as its search is far longer than its bytes tell.
    left, right = (rows.repartition(shards, "shard", "size") for rows in (dealt, sent))
    found = left.groupBy("shard", "size").cogroup(right.groupBy("shard", "size")).applyInArrow(search, "query_id long, id long, score double")
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
