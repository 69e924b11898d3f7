"""Quality and toxicity by hierarchical empirical Bayes.

A classifier over hashed pieces of words gives each document its own evidence that it is poor, and that it is toxic. One
task fits it on a sample of labelled rows: the first `fit_rows` in the order of a hash of their ids, of these the texts
of at most a hundredth of `fit_bytes`, and of these the first `fit_bytes` in all. The driver gets the weights, which have
a fixed size. Documents, whole texts of any length, are then scored and counted by path and by host, each with its label
or else with the classifier's probability. A path's rate is shrunk toward its host's and a host's toward the global rate,
in each case by a prior strength that the method of moments takes from how much the groups differ beyond chance; a site
with few documents thus says little. A document's posterior adds the shift of its path's rate, itself left out, to its
own evidence on the logit scale.

All counts are grouped aggregates over all documents, summed in each task first, so a host with a third of all rows
is a few partial sums.

Defined results: null and empty texts have no evidence of their own and take the rate of their site; null hosts and
paths are sites of their own; without labels, or without both kinds, every evidence is zero; an
id with several labels has the lowest quality and the highest toxicity of them; repeated rows count as they come.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, in_chunks

FIT_ROWS, FIT_BYTES = 8_000, 32 << 20
BITS = 18
EPOCHS = 5
#: Share of the sample that fits the scores of words; the rest fits how they combine.
FIRST_SHARE = 0.7
CHUNK_BYTES = 4 << 20
MOST_WORDS = 400_000
TARGETS, WEIGHTS = ("poor", "toxic"), ("linear", "odds", "blend")


def words_of(text: str | None) -> list[bytes]:
    return sorted(set((text or "").lower().encode("utf-8", "surrogatepass").split()))


def pieces(word: bytes) -> tuple[list[int], list[int]]:
    """Numbers below 2^BITS for a word and its beginnings, and for its runs of four bytes."""
    core = word.strip(b".,;:!?\"'()|%*$&#")
    edged = b"^" + word + b"$$"
    named = [b"=" + core, *(b"<" + core[:n] for n in (6, 8, 10) if len(core) > n)]
    most = (1 << BITS) - 1
    return [crc32(k) & most for k in named], [crc32(edged[i : i + 4]) & most for i in range(len(edged) - 3)]


class Pieces(NamedTuple):
    """The pieces of words, one after another, and how many each word has; runs are never none."""

    named: np.ndarray
    n_named: np.ndarray
    runs: np.ndarray
    n_runs: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Pieces:
        found = [pieces(w) for w in words]
        flat = lambda k: np.fromiter((p for x in found for p in x[k]), np.int32)
        size = lambda k: np.array([len(x[k]) for x in found], np.int32)
        return cls(flat(0), size(0), flat(1), size(1))


class Model:
    """Evidence on one target. A document's features are the mean score of its words under a logistic regression on
    pieces, and the greatest, the mean of the three greatest and the total of its words' own scores: the least that
    the odds of the word, or of a beginning of it, can be by the counts of the sample. A second regression on other
    rows combines them."""

    def __init__(self, linear: np.ndarray | None = None, odds: np.ndarray | None = None, blend: np.ndarray | None = None) -> None:
        self.linear = np.zeros(1 << BITS) if linear is None else linear
        self.odds = np.zeros(1 << BITS) if odds is None else odds
        self.blend = np.zeros(5) if blend is None else blend

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.linear, self.odds, self.blend

    def word_scores(self, words: Pieces) -> np.ndarray:
        """(linear score, own score) of each word."""
        out = np.zeros((len(words.n_named), 2))
        if len(out):
            starts, more = np.cumsum(words.n_named) - words.n_named, np.cumsum(words.n_runs) - words.n_runs
            out[:, 0] = np.add.reduceat(self.linear[words.named], starts) + np.add.reduceat(self.linear[words.runs], more)
            out[:, 1] = np.maximum.reduceat(self.odds[words.named], starts)
        return out


def document_features(scores: np.ndarray) -> np.ndarray:
    """Features of one document from the scores of its distinct words, for one target."""
    if not len(scores):
        return np.array([0.0, 0.0, 0.0, 0.0, 1.0])
    root = np.sqrt(len(scores) + 1)
    top = np.sort(scores[:, 1])[-3:]
    return np.array([scores[:, 0].sum() / root, max(top[-1], 0), max(top.sum() / 3, 0), np.maximum(scores[:, 1], 0).sum() / root, 1.0])


def descend(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, size: int, epochs: int, rate: float, seed: int) -> np.ndarray:
    """Weights of a logistic regression on sparse rows (places, values), by AdaGrad."""
    weights, squares = np.zeros(size), np.full(size, 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            step = (1 / (1 + np.exp(-np.clip(weights[at] @ x, -30, 30))) - target[i]) * x + 1e-6 * weights[at]
            squares[at] += step * step
            weights[at] -= rate * step / np.sqrt(squares[at])
    return weights


def fit(docs: list[Pieces], target: np.ndarray) -> Model:
    """The model of one target from the sample's documents; all zero if either part of the sample has one kind only."""
    model = Model()
    cut = int(len(docs) * FIRST_SHARE)
    if not cut or len(set(target[:cut])) < 2 or len(set(target[cut:])) < 2:
        return model
    size = 1 << BITS
    # Odds: of documents with the piece against documents without, less a bound of 1.5 standard deviations.
    counts = np.zeros((2, size))
    rows = []
    for words, t in zip(docs[:cut], target[:cut]):
        counts[int(t), np.unique(words.named)] += 1
        at, n = np.unique(np.concatenate([words.named, words.runs]), return_counts=True)
        rows.append((np.r_[at, size].astype(np.int32), np.r_[n / np.sqrt(len(words.n_named) + 1), 1.0].astype(np.float32)))
    total = np.array([[(target[:cut] == 0).sum()], [(target[:cut] == 1).sum()]])
    with_, without = counts + 0.5, total - counts + 0.5
    delta = np.log(with_[1] / without[1]) - np.log(with_[0] / without[0])
    spread = np.sqrt((1 / with_ + 1 / without).sum(axis=0))
    model.odds = np.sign(delta) * np.maximum(np.abs(delta) - 1.5 * spread, 0)
    model.linear = descend(rows, target[:cut], size + 1, EPOCHS, 0.2, 3)[:size]
    found = [(np.arange(5), document_features(model.word_scores(words))) for words in docs[cut:]]
    model.blend = descend(found, target[cut:], 5, 40, 0.1, 4)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_bytes: int, id_column: str, text_column: str) -> DataFrame:
    """(place, text, poor, toxic) of the labelled rows that fit the model."""
    known = targets_of(labels, id_column).where(F.col("_id").isNotNull() & F.col("poor").isNotNull() & F.col("toxic").isNotNull())
    chosen = known.select(F.xxhash64("_id").alias("place"), "_id", "poor", "toxic").orderBy("place", "_id").limit(fit_rows)
    texts = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    found = texts.join(F.broadcast(chosen), "_id")  # fit_rows short rows
    return found.where(F.octet_length("_text") <= fit_bytes // 100).select("place", F.xxhash64("_text").alias("key"), "_text", "poor", "toxic")


def targets_of(labels: DataFrame, id_column: str) -> DataFrame:
    poor, toxic = 1 - F.min(F.col("quality").cast("int")), F.max(F.col("toxic").cast("int"))
    return labels.groupBy(F.col(id_column).alias("_id")).agg(poor.alias("poor"), toxic.alias("toxic"))


def fit_models(sample: DataFrame, fit_bytes: int) -> list[Model]:
    """The models of the targets, fitted in one task on the first `fit_bytes` of the sample."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, targets, left = [], [], fit_bytes
        for batch in in_chunks(batches, "_text", CHUNK_BYTES):
            so_far = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False))
            own = batch.slice(0, int((so_far <= left).sum()))
            left = left - int(so_far[-1]) if own.num_rows == batch.num_rows else 0
            docs += [Pieces.of(words_of(t)) for t in own.column("_text").to_pylist()]
            targets.append(np.stack([own.column(t).to_numpy() for t in TARGETS], axis=1))
        for k in range(len(TARGETS)):
            model = fit(docs, np.concatenate(targets)[:, k].astype(np.int64)) if docs else Model()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([w.astype("<f8").tobytes()]) for w in model.weights())], names=["target", *WEIGHTS])

    shape = f"target int, {', '.join(f'{w} binary' for w in WEIGHTS)}"
    rows = sample.repartition(1).sortWithinPartitions("place", "key").mapInArrow(run, shape).collect()  # a row a target
    return [Model(*(np.frombuffer(r[w], "<f8") for w in WEIGHTS)) for r in sorted(rows, key=lambda r: r["target"])] or [Model() for _ in TARGETS]


def with_evidence(docs: DataFrame, models: list[Model], keep: list[str], text_column: str) -> DataFrame:
    """The `keep` columns with evidence_poor and evidence_toxic, logits of the classifier."""
    cache: dict[bytes, tuple[float, ...]] = {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, text_column, CHUNK_BYTES):
            own = [words_of(t) for t in batch.column(text_column).to_pylist()]
            if len(cache) > MOST_WORDS:
                cache.clear()
            new = [w for w in set().union(*own) if w not in cache]
            if new:
                found = Pieces.of(new)
                scores = np.concatenate([m.word_scores(found) for m in models], axis=1)
                cache.update(zip(new, map(tuple, scores.tolist())))
            found = np.zeros((len(own), len(models)))
            for i, words in enumerate(own):
                scores = np.array([cache[w] for w in words]).reshape(-1, 2 * len(models))
                for k, m in enumerate(models):
                    found[i, k] = m.blend @ document_features(scores[:, 2 * k : 2 * k + 2])
            found = np.clip(found, -30, 30)
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *(pa.array(found[:, k]) for k in range(len(models)))], names=[*keep, *(f"evidence_{t}" for t in TARGETS)])

    ins = docs.select(*dict.fromkeys([*keep, text_column]))
    shape = ", ".join(f"`{c}` {ins.schema[c].dataType.simpleString()}" for c in keep)
    return ins.mapInArrow(run, f"{shape}, evidence_poor double, evidence_toxic double")


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(bounded / (1 - bounded))


def strength(rows: DataFrame, n: str, own: str, center: str) -> Column:
    """Aggregate expression: the prior strength of groups with `n` members and rate `own` around `center`.

    The spread of the rates beyond what chance gives, by moments; no spread beyond it is the greatest strength.
    """
    chance = F.sum(F.col(center) * (1 - F.col(center)) * F.col(n)) / F.sum(n)
    spread = F.sum(F.col(n) * F.pow(F.col(own) - F.col(center), 2)) - (F.count("*") - 1) * chance
    room = F.sum(n) - F.sum(F.col(n) * F.col(n)) / F.sum(n)
    between = F.when(room > 0, spread / room)
    return F.when(between > 0, F.least(F.greatest(chance / between - 1, F.lit(2.0)), F.lit(1e4))).otherwise(1e4)


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_column: str = "doc_id", text_column: str = "text", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """(id, p_quality, p_toxic, kept) for every row; kept rows are of quality and not toxic, at even odds."""
    models = fit_models(labelled_sample(docs, labels, fit_rows, fit_bytes, id_column, text_column), fit_bytes)
    sited = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), host.alias("_host"), path.alias("_path"))
    scored = with_evidence(sited, models, ["_id", "_host", "_path"], "_text")
    rows = scored.join(targets_of(labels, id_column), "_id", "left")
    for t in TARGETS:
        rows = rows.withColumn(f"seen_{t}", F.coalesce(F.col(t).cast("double"), logistic(F.col(f"evidence_{t}"))))
    rows = checkpointed(rows.select("_id", "_host", "_path", *(f"{kind}_{t}" for kind in ("evidence", "seen") for t in TARGETS)))
    paths = rows.groupBy("_host", "_path").agg(F.count("*").alias("n_path"), *(F.sum(f"seen_{t}").alias(f"path_{t}") for t in TARGETS))
    hosts = paths.groupBy("_host").agg(F.sum("n_path").alias("n_host"), *(F.sum(f"path_{t}").alias(f"host_{t}") for t in TARGETS))
    every = hosts.agg(F.sum("n_host").alias("n_all"), *((F.sum(f"host_{t}") / F.sum("n_host")).alias(f"all_{t}") for t in TARGETS))
    hosts = hosts.crossJoin(F.broadcast(every))  # one row
    for t in TARGETS:
        hosts = hosts.withColumn(f"rate_{t}", F.col(f"host_{t}") / F.col("n_host"))
    host_strength = hosts.agg(*(strength(hosts, "n_host", f"rate_{t}", f"all_{t}").alias(f"hold_host_{t}") for t in TARGETS))
    sites = paths.join(hosts, paths["_host"].eqNullSafe(hosts["_host"])).drop(hosts["_host"])
    for t in TARGETS:
        sites = sites.withColumn(f"own_{t}", F.col(f"path_{t}") / F.col("n_path"))
    path_strength = sites.agg(*(strength(sites, "n_path", f"own_{t}", f"rate_{t}").alias(f"hold_path_{t}") for t in TARGETS))
    sites = sites.crossJoin(F.broadcast(host_strength)).crossJoin(F.broadcast(path_strength))  # one row each
    sites = sites.withColumnsRenamed({"_host": "_site_host", "_path": "_site_path"})
    joined = rows.join(sites, F.col("_host").eqNullSafe(F.col("_site_host")) & F.col("_path").eqNullSafe(F.col("_site_path")))
    for t in TARGETS:
        whole, own = F.col(f"all_{t}"), F.col(f"seen_{t}")
        host_rate = (F.col(f"host_{t}") - own + F.col(f"hold_host_{t}") * whole) / (F.col("n_host") - 1 + F.col(f"hold_host_{t}"))
        path_rate = (F.col(f"path_{t}") - own + F.col(f"hold_path_{t}") * host_rate) / (F.col("n_path") - 1 + F.col(f"hold_path_{t}"))
        joined = joined.withColumn(f"p_{t}", logistic(F.col(f"evidence_{t}") + logit(path_rate) - logit(whole)))
    kept = (F.col("p_poor") < 0.5) & (F.col("p_toxic") < 0.5)
    return joined.select(F.col("_id").alias(id_column), (1 - F.col("p_poor")).alias("p_quality"), "p_toxic", kept.alias("kept"))
