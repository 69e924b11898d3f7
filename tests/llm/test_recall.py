"""Recall of the neighbour graph at the shard size that queries use."""

import numpy as np
import pytest

from collatrix.llm import ann


@pytest.mark.parametrize("lengths", ["equal", "as they come", "tenfold"])
def test_recall_on_a_full_shard(lengths):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(ann.SHARD_ROWS, 64))
    if lengths == "equal":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths == "tenfold":
        x *= 10 ** rng.uniform(-1, 0, (len(x), 1))
    asked = np.arange(0, len(x), 40)
    found = ann.Graph(x).search(x[asked])
    hits = 0
    for q, own in zip(asked, found):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(np.argpartition(-score, 20)[:20].tolist())
        near = own[(own >= 0) & (own != q)]
        hits += len(best & set(near[np.argsort(-score[near])[:20]].tolist()))
    assert hits / (20 * len(asked)) >= 0.97


def test_small_shards_are_read_whole():
    x = np.random.default_rng(2).normal(size=(150, 3)) * 1e200
    assert sorted(ann.Graph(x).search(x[:1])[0, :150].tolist()) == list(range(150))


def test_no_vectors_and_clashing_names(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, shard string, score string")
    assert ann.nearest(empty, empty).count() == 0
    rows = [(i, [float(i), 1.0], "x", "y") for i in range(5)] + [(5, [1.0], "x", "y"), (2, [2.0, 1.0], "x", "z")]
    got = ann.nearest(spark.createDataFrame(rows, empty.schema), spark.createDataFrame(rows[:1], empty.schema)).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, k + 1, k + 1, 1.0) for k in range(4)]
