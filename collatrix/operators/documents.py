"""Whole documents against each other: tokens of lines, their streams, paired floats, and the alignment of all streams.

Lines are those of `structure` (doc_id, page, line_no, kind, words) with their object: object_id, object_kind and whether the line is
its first. Tokens (doc_id, tok, norm, line_id, stream) are in reading order; running text, footnotes and each float are streams of
their own, so that a float set elsewhere is not a move.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .alignment import Alignment
from .matching import greedy_pairs

# Kinds that are compared, hyphens at line ends, digit groups, numbers of floats and equations.
COMPARED = ("body", "heading", "caption", "table", "equation", "toc", "footnote")
HYPHEN, DIGITS, DIGITS_BEFORE, GROUP_GAP = r"(?i)[a-z]{2}-$", r"^[0-9]{3}[.,;:)]*$", r"(^|[^0-9.])[0-9]{1,3}$", 0.4
FLOAT_NUMBER, EQUATION_NUMBER = r"^[A-Z]?[0-9]+(\.[0-9]+)?[:.]$", r"^\((?:[A-Z]\.)?[0-9]+[a-z]?\)[.,]?$"
# Fixed values of the pairing of floats.
SAME_HASH, SAME_NUMBER, APART, LEAST_FLOAT = 0.3, 0.02, 0.05, 0.4


def compared(lines: DataFrame) -> DataFrame:
    """Lines that are compared: all but headers and footers."""
    return lines.where(F.col("kind").isin(*COMPARED))


def stream_of(kind: Column, object_kind: Column, object_id: Column) -> Column:
    """notes, float:<object> for captions and rows of figures and tables, else body."""
    in_float = kind.isin("caption", "table") & object_id.isNotNull() & (object_kind != "equation")
    return F.when(kind == "footnote", "notes").when(in_float, F.concat(F.lit("float:"), object_id)).otherwise("body")


def tokens_of_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, tok, norm, page, line_no, stream): words with hyphens at line ends undone, digit groups joined, and numbers of
    floats and equations as placeholders, as their renumbering is told by the pairing of objects."""
    words = compared(lines).select("doc_id", "page", "line_no", "kind", "object_id", "object_kind", "first_line", F.size("words").alias("n"), F.posexplode("words").alias("k", "w"))
    order = W.partitionBy("doc_id").orderBy("page", "line_no", "k")
    before = lambda c: F.lag(c).over(order)
    rows = words.withColumns({"raw": F.col("w.norm"), "last": F.col("k") == F.col("n") - 1})
    hyphen = F.col("last") & F.col("kind").isin("body", "footnote") & F.col("raw").rlike(HYPHEN)
    rows = rows.withColumn("hyphen", hyphen).withColumn("joins_line", F.coalesce((F.col("k") == 0) & before("hyphen") & F.col("raw").rlike("^[a-z]"), F.lit(False)))
    near = F.col("w.box.x0") - before("w.box.x1") < GROUP_GAP * (F.col("w.box.y1") - F.col("w.box.y0"))
    group = (F.col("k") > 0) & F.col("raw").rlike(DIGITS) & before("raw").rlike(DIGITS_BEFORE) & near
    rows = rows.withColumn("group", F.coalesce(group, F.lit(False)))
    # Of groups in a row each second one joins: the number before is complete then.
    run = F.sum((~F.col("group")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("run", run).withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "run").orderBy("page", "line_no", "k")))
    joins = F.col("joins_line") | (F.col("group") & (F.col("nth") % 2 == 0))
    caption = (F.col("kind") == "caption") & F.coalesce(F.col("object_kind") != "equation", F.lit(False)) & F.coalesce("first_line", F.lit(False)) & (F.col("k") == 1) & F.col("raw").rlike(FLOAT_NUMBER)
    shown = F.when(caption, F.concat(F.lit("#"), F.substring("raw", -1, 1))).when((F.col("kind") == "equation") & F.col("last") & F.col("raw").rlike(EQUATION_NUMBER), "(#)").otherwise(F.col("raw"))
    told = rows.withColumns({"joins": joins, "shown": shown}).withColumn("tok", (F.sum((~F.col("joins")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int"))
    cut = F.when(F.coalesce(F.lead("joins_line").over(order), F.lit(False)), F.expr("substring(shown, 1, length(shown) - 1)")).otherwise(F.col("shown"))
    part = F.struct("page", "line_no", "k", "text")
    named = told.withColumns({"text": cut, "stream": stream_of(F.col("kind"), F.col("object_kind"), F.col("object_id"))})
    made = named.groupBy("doc_id", "tok").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min_by("stream", F.struct("page", "line_no", "k")).alias("stream"))
    return made.select("doc_id", "tok", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("norm"), F.col("parts")[0]["page"].alias("page"), F.col("parts")[0]["line_no"].alias("line_no"), "stream")


def float_candidates(pairs: DataFrame, tokens: DataFrame, objects: DataFrame) -> DataFrame:
    """(a, b, a_object, b_object, score): floats of one kind, by common words, equal graphics and number, and place.

    Objects: (doc_id, object_id, kind, number, hashes). Pairs of floats without a common word count by the rest alone.
    """
    in_float = tokens.where(F.startswith("stream", F.lit("float:"))).withColumn("object_id", F.expr("cast(substring(stream, 7) as int)"))
    word = F.regexp_replace(F.lower("norm"), r"^[(\[]+|[.,;:)\]]+$", "")
    bag = in_float.groupBy("doc_id", "object_id", word.alias("word")).agg(F.count("*").alias("n"))
    sizes = in_float.groupBy("doc_id", "object_id").agg(F.count("*").alias("size"), F.min("tok").alias("first"))
    order = W.partitionBy("doc_id")
    placed = sizes.withColumn("rel", (F.row_number().over(order.orderBy("first")) - 1) / F.greatest(F.lit(1), F.count("*").over(order) - 1)).join(objects.select("doc_id", "object_id", "kind", "number", "hashes"), ["doc_id", "object_id"])
    side = lambda df, k: df.select(F.col("doc_id").alias(k), *[F.col(c).alias(f"{k}_{c}" if c not in ("kind", "word") else c) for c in df.columns if c != "doc_id"])
    met = pairs.select("a", "b").join(side(placed, "a"), "a").join(side(placed, "b"), ["b", "kind"])
    common = pairs.select("a", "b").join(side(bag, "a"), "a").join(side(bag, "b"), ["b", "word"]).groupBy("a", "b", "a_object_id", "b_object_id").agg(F.sum(F.least("a_n", "b_n")).alias("common"))
    rows = met.join(common, ["a", "b", "a_object_id", "b_object_id"], "left")
    equal = (F.col("kind") == "figure") & F.exists(F.array_intersect("a_hashes", "b_hashes"), lambda h: h != "")
    score = 2 * F.coalesce("common", F.lit(0)) / (F.col("a_size") + F.col("b_size")) + F.when(equal, SAME_HASH).otherwise(0.0) + F.when(F.col("a_number") == F.col("b_number"), SAME_NUMBER).otherwise(0.0) - APART * F.abs(F.col("a_rel") - F.col("b_rel"))
    return rows.select("a", "b", F.col("a_object_id").alias("a_object"), F.col("b_object_id").alias("b_object"), score.alias("score"))


def pair_floats(pairs: DataFrame, tokens: DataFrame, objects: DataFrame) -> DataFrame:
    """(a, b, a_object, b_object, score): one to one, the best first."""
    found = float_candidates(pairs, tokens, objects).withColumn("pair", F.concat_ws("\n", "a", "b"))
    keyed = found.select("pair", "a", "b").distinct()
    return greedy_pairs(found, "pair", "a_object", "b_object", "score", LEAST_FLOAT).join(keyed, "pair").select("a", "b", "a_object", "b_object", "score")


ALIGNED = "a string, b string, side string, tok int, other int, state string, move int"
STATES = {0: "same", 1: "changed", 2: "moved"}


def align_documents(pairs: DataFrame, tokens: DataFrame, floats: DataFrame) -> DataFrame:
    """(a, b, side, tok, other, state, move): for each token of both documents its partner, whether it is the same,
    changed or moved, and the moved block that it belongs to. A pair of documents is one row; its streams are aligned one
    by one: the running text with its moves, the footnotes, and each float with its partner."""
    whole = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok", "norm", "stream"))).alias("tokens"))
    matched = floats.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("a_object", "b_object"))).alias("floats"))
    rows = pairs.select("a", "b").join(whole.toDF("a", "left"), "a").join(whole.toDF("b", "right"), "b").join(matched, ["a", "b"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ALIGNED.split(", ")]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32())
        for batch in batches:
            for a, b, left, right, met in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "left", "right", "floats"))):
                found = _aligned(left, right, met or [])
                columns = list(zip(*((a, b, *r) for r in found))) if found else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rows.select("a", "b", "left", "right", "floats").mapInArrow(run, ALIGNED)


def _aligned(left: list[dict], right: list[dict], floats: list[dict]) -> list[tuple]:
    streams = [{}, {}]
    for own, side in zip(streams, (left, right)):
        for k, t in enumerate(side):
            own.setdefault(t["stream"], []).append(k)
    partner = {"body": "body", "notes": "notes"} | {f"float:{f['a_object']}": f"float:{f['b_object']}" for f in floats}
    both = [(s, partner.get(s)) for s in streams[0]] + [(None, s) for s in streams[1] if s not in {partner.get(x) for x in streams[0]}]
    out: list[tuple] = []
    moves = 0
    for s, t in both:
        at = [np.array(own.get(name, []), np.int64) for own, name in zip(streams, (s, t))]
        texts = [[side[k]["norm"] for k in own] for own, side in zip(at, (left, right))]
        found = Alignment(*texts, s == "body", *at)
        block = {}
        for move, (i, j) in enumerate(found.moves, moves):
            block |= {("a", k): move for k in i} | {("b", k): move for k in j}
        moves += len(found.moves)
        for side, own, other, to, state, told in (("a", at[0], at[1], found.to_b, found.state_a, left), ("b", at[1], at[0], found.to_a, found.state_b, right)):
            beyond = right if side == "a" else left
            for k, p in enumerate(own):
                mate = beyond[other[to[k]]]["tok"] if to[k] >= 0 else None
                out.append((side, told[p]["tok"], mate, STATES[int(state[k])], block.get((side, k))))
    return out


def run_lengths(aligned: DataFrame) -> DataFrame:
    """Tokens with a partner and how long the run is in which they and their neighbours stay neighbours."""
    line = W.partitionBy("a", "b", "side").orderBy("tok")
    paired = aligned.where("other is not null")
    starts = (F.col("tok") - F.lag("tok").over(line) != 1) | (F.col("other") - F.lag("other").over(line) != 1)
    island = paired.withColumn("_run", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)))
    return island.withColumn("run", F.count("*").over(W.partitionBy("a", "b", "side", "_run"))).drop("_run")


def move_summaries(aligned: DataFrame, tokens: DataFrame, first: int = 10, around: int = 6) -> DataFrame:
    """(a, b, move, words, first, after_a, after_b): how long moved blocks are, their first words, and the words that they
    stood after."""
    moved = aligned.where("move is not null")
    spans = moved.groupBy("a", "b", "move").agg(F.count_if(F.col("side") == "a").alias("words"), F.min(F.when(F.col("side") == "a", F.col("tok"))).alias("a_at"), F.min(F.when(F.col("side") == "b", F.col("tok"))).alias("b_at"))

    def said(doc: str, at: str, lo: int, hi: int, name: str) -> DataFrame:
        words = tokens.select(F.col("doc_id").alias(doc), "tok", "norm")
        met = spans.select("a", "b", "move", F.col(at).alias("_at")).join(words, doc).where((F.col("tok") >= F.col("_at") + lo) & (F.col("tok") < F.col("_at") + hi))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok", "norm"))), lambda s: s["norm"]), " ")
        return met.groupBy("a", "b", "move").agg(text.alias(name))

    key = ["a", "b", "move"]
    rows = spans.select(*key, "words").join(said("a", "a_at", 0, first, "first"), key, "left")
    return rows.join(said("a", "a_at", -around, 0, "after_a"), key, "left").join(said("b", "b_at", -around, 0, "after_b"), key, "left").fillna("", ["first", "after_a", "after_b"])


def insertion_places(aligned: DataFrame, starts: DataFrame) -> DataFrame:
    """(a, b, object, b_at): where a float of a without partner would stand in b: after the partner of the closest mapped
    token before it, else at the beginning. `starts` has (a, b, object, tok)."""
    rows = aligned.where("side = 'a'").select("a", "b", "tok", "other", F.lit(None).cast("int").alias("object")).unionByName(starts.select("a", "b", "tok", F.lit(None).cast("int").alias("other"), "object"))
    before = W.partitionBy("a", "b").orderBy("tok", F.col("object").isNull()).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("b_at", F.coalesce(F.last("other", ignorenulls=True).over(before) + 1, F.lit(0))).where("object is not null").select("a", "b", "object", "b_at")
