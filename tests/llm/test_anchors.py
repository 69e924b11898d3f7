"""Hot anchors and components of the fingerprint groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from collatrix.llm import simhash


def test_hot_anchors_keep_every_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = int(rng.integers(0, 2**63))
        y = x
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            y ^= 1 << int(bit)
        fps = np.array([[x], [y]], np.uint64)
        index, key, home = simhash.anchors(fps, simhash.HALVES)
        index, key, home = simhash.split_hot(fps, index, key, home, np.unique(key), False)
        assert set(key[(index == 0) & home]) & set(key[index == 1])
        assert set(key[(index == 1) & home]) & set(key[index == 0])


def test_many_fingerprints_at_one_anchor(spark):
    """10^5 fingerprints with one lower half: links are found, and no place of theirs gathers a great part."""
    rng = np.random.default_rng(5)
    high = np.unique(rng.integers(0, 2**32, 100_000, dtype=np.uint64))
    near = high[:200] ^ np.uint64(1 << 7) ^ np.uint64(1 << 21)
    fps = np.unique(np.concatenate([high, near]) << np.uint64(32) | np.uint64(12345))
    index, key, home = simhash.anchors(fps[:, None], simhash.HALVES, True)
    hot = np.array([k for k, n in zip(*np.unique(key, return_counts=True)) if n > 10_000])
    assert len(hot) == 1
    _, split, _ = simhash.split_hot(fps[:, None], index, key, home, hot, True)
    assert np.unique(split, return_counts=True)[1].max() < 2_000
    nodes = spark.range(len(fps)).select(F.col("id").alias("at"))
    values = spark.createDataFrame([(int(i), int(v)) for i, v in enumerate(fps.view(np.int64))], "at long, fp long")
    rows = nodes.join(values, "at").select("fp", F.col("fp").alias("label"))
    got = {(r.a, r.b) for r in simhash.near_pairs(rows, ["fp"], simhash.HALVES, 3).collect()}
    wanted = [(int(a), int(b)) for a, b in zip((high[:200] << np.uint64(32) | np.uint64(12345)).view(np.int64), (near << np.uint64(32) | np.uint64(12345)).view(np.int64))]
    linked = {}
    for a, b in got:
        linked.setdefault(a, set()).add(b)
        linked.setdefault(b, set()).add(a)
    for a, b in wanted:
        seen, todo = {a}, [a]
        while todo:
            for c in linked.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        assert b in seen
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in got)


@pytest.mark.parametrize("last", [0, 1 << 20])
def test_components_equal_a_search(spark, last):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    links = [(a, b) for a, b in links if a != b]
    label = {x: x for pair in links for x in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(links, "a long, b long"), last).collect()}
    assert set(got) == set(label)
    groups = {}
    for x, own in got.items():
        groups.setdefault(own, set()).add(label[x])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(label.values()))
    assert simhash.components(spark.createDataFrame([], "a long, b long"), last).count() == 0
