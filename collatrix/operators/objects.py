"""Pairing of figures, tables and equations, of their panels, and of pages, between two versions.

Candidates are joins. Choosing among them one to one is sequential within a pair of versions; candidate lists are short
(objects of two documents) and stream through partitions that are sorted by pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import iou
from .matching import bags

# Fixed values of the pairing.
LEAST_SCORE, HASH_SCORE, LEAST_CAPTION = 0.25, 0.6, 0.4
REWORDED_WORDS, REWORDED_SHARE = 5, 0.35
PAGE_WEIGHT, LEAST_OVERLAP, RESIZED = 0.05, 0.5, 0.1


def caption_words(caption: str | Column) -> Column:
    """The words of a caption: without its label, numbers in brackets and single letters."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(caption), r"^(figure|table|fig\.)\s*\S+", ""), r"\([0-9]+\)", " ")
    return F.filter(F.regexp_extract_all(bare, F.lit(r"([^\s.,;:()\[\]]+)"), 1), lambda w: F.length(w) > 1)


def vote_scores(votes: DataFrame, sizes_a: DataFrame, sizes_b: DataFrame) -> DataFrame:
    """(pair_id, a, b, score) from aligned tokens (pair_id, a, b, n) and sizes (pair_id, object, size)."""
    named = lambda s, k: s.select("pair_id", F.col("object").alias(k), F.col("size").alias(f"{k}_size"))
    rows = votes.join(named(sizes_a, "a"), ["pair_id", "a"]).join(named(sizes_b, "b"), ["pair_id", "b"])
    share = F.col("n") / F.greatest("a_size", "b_size")
    reworded = (F.col("n") >= REWORDED_WORDS) & (F.col("n") / F.least("a_size", "b_size") >= REWORDED_SHARE)
    return rows.select("pair_id", "a", "b", F.when((share < LEAST_SCORE) & reworded, F.lit(LEAST_SCORE)).otherwise(share).alias("score"))


def hash_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Figures with a fingerprint in common. Objects: (pair_id, id, kind, number, caption, page, pages, box, hashes)."""
    spread = lambda o, k: o.where("kind = 'figure'").select("pair_id", F.col("id").alias(k), F.explode(F.array_distinct("hashes")).alias("hash")).where("hash <> ''")
    return spread(a, "a").join(spread(b, "b"), ["pair_id", "hash"]).select("pair_id", "a", "b", F.lit(HASH_SCORE).alias("score")).distinct()


def caption_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair_id, kind, a, b, similarity): Dice of captions that both have four words, for pairs with a word in common."""
    bag = lambda o, k: bags(o.withColumn(k, F.col("id")), ["pair_id", "kind", k], caption_words(F.coalesce("caption", F.lit(""))))
    x, y = bag(a, "a"), bag(b, "b")
    size = lambda s, k: s.groupBy("pair_id", k).agg(F.sum("n").alias(f"{k}_size"))
    met = x.withColumnRenamed("n", "m").join(y, ["pair_id", "kind", "word"]).groupBy("pair_id", "kind", "a", "b").agg(F.sum(F.least("m", "n")).alias("common"))
    scored = met.join(size(x, "a"), ["pair_id", "a"]).join(size(y, "b"), ["pair_id", "b"])
    enough = (F.col("a_size") >= 4) & (F.col("b_size") >= 4)
    return scored.select("pair_id", "kind", "a", "b", F.when(enough, 2 * F.col("common") / (F.col("a_size") + F.col("b_size"))).otherwise(0.0).alias("similarity"))


def pair_objects(a: DataFrame, b: DataFrame, votes: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(pair_id, a, b, tier): pairs by the first tier that has them: 0 chosen by the user, 1 aligned text or equal
    graphics, 2 similar captions, 3 kind and number, 4 place of graphics without number.

    `votes` is (pair_id, a, b, score); `chosen` (pair_id, a, b), where null on one side keeps the other unpaired.
    """
    first = votes.select("pair_id", "a", "b", "score").unionByName(hash_candidates(a, b)).where(F.col("score") >= LEAST_SCORE)
    side = lambda o, k: o.select("pair_id", F.col("id").alias(k), F.col("kind").alias(f"{k}_kind"), F.col("number").alias(f"{k}_number"), (F.col("page") / F.col("pages")).alias(f"{k}_at"), F.col("page").alias(f"{k}_page"), F.col("box").alias(f"{k}_box"))
    left, right = side(a, "a"), side(b, "b")
    captions = caption_scores(a, b).join(left, ["pair_id", "a"]).join(right, ["pair_id", "b"])
    away = F.abs(F.col("a_at") - F.col("b_at"))
    second = captions.where((F.col("kind") != "equation") & (F.col("similarity") >= LEAST_CAPTION)).select("pair_id", "a", "b", (F.col("similarity") - PAGE_WEIGHT * away).alias("score"))
    met = left.join(right, "pair_id").where(F.col("a_kind") == F.col("b_kind"))
    similar = captions.select("pair_id", "a", "b", "similarity")
    short = lambda o, k: o.select("pair_id", F.col("id").alias(k), (F.size(F.array_distinct(caption_words(F.coalesce("caption", F.lit(""))))) < 4).alias(f"{k}_short"))
    numbered = met.where((F.col("a_number") == F.col("b_number")) & (F.col("a_number") != "")).join(short(a, "a"), ["pair_id", "a"]).join(short(b, "b"), ["pair_id", "b"]).join(similar, ["pair_id", "a", "b"], "left")
    alike = F.coalesce("similarity", F.lit(0.0))
    equation, brief = F.col("a_kind") == "equation", F.col("a_short") | F.col("b_short")
    unrelated = (
        F.when(equation & (F.col("a_short") != F.col("b_short")), True)
        .when(brief, False)
        .when(equation, alike < 0.2)
        .otherwise((alike < 0.15) | ((alike < 0.3) & (away > 0.04)))
    )
    third = numbered.where(~unrelated).select("pair_id", "a", "b", (-F.col("b").cast("double")).alias("score"))
    box = lambda k: tuple(F.col(f"{k}_box")[c] for c in ("x0", "y0", "x1", "y1"))
    placed = met.where((F.col("a_kind") == "figure") & (F.col("a_number") == "") & (F.col("b_number") == "") & (F.col("a_page") == F.col("b_page")) & (iou(box("a"), box("b")) > LEAST_OVERLAP))
    fourth = placed.select("pair_id", "a", "b", (-F.col("b").cast("double")).alias("score"))
    tiers = [first, second, third, fourth]
    every = None if chosen is None else chosen.select("pair_id", "a", "b", F.lit(1.0).alias("score"), F.lit(0).alias("tier"))
    for tier, rows in enumerate(tiers, 1):
        rows = rows.withColumn("tier", F.lit(tier))
        every = rows if every is None else every.unionByName(rows)
    # The last two tiers go through the old objects in order; the others by score.
    order = F.when(F.col("tier") >= 3, F.col("a").cast("double")).otherwise(-F.col("score"))
    dealt = every.withColumn("place", order).repartition("pair_id").sortWithinPartitions("pair_id", "tier", "place", F.desc("score"), "a", "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used_a, used_b = None, set(), set()
        for batch in batches:
            keep = []
            for pair, x, y, tier in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "a", "b", "tier"))):
                if pair != current:
                    current, used_a, used_b = pair, set(), set()
                takes = x is not None and y is not None and (tier == 0 or (x not in used_a and y not in used_b))
                if takes or tier == 0:
                    used_a.add(x)
                    used_b.add(y)
                keep.append(takes)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["pair_id", "a", "b", "tier"])

    kinds = {c: every.schema[c].dataType.simpleString() for c in ("pair_id", "a", "b", "tier")}
    return dealt.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def unpaired(objects: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Objects that no pair has: removed on the old side, added on the new."""
    return objects.join(pairs.select("pair_id", F.col(side).alias("id")), ["pair_id", "id"], "left_anti")


def pair_panels(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a_part, b_part, same): panels (key, part, hash) with equal fingerprints first, the rest in reading order."""
    times = W.partitionBy("key", "hash").orderBy("part")
    known = lambda p, k: p.where("hash <> ''").select("key", "hash", F.col("part").alias(k), F.row_number().over(times).alias("nth"))
    equal = known(a, "a_part").join(known(b, "b_part"), ["key", "hash", "nth"]).select("key", "a_part", "b_part", F.lit(True).alias("same"))
    turn = W.partitionBy("key").orderBy("part")
    rest = lambda p, k: p.join(equal.select("key", F.col(k).alias("part")), ["key", "part"], "left_anti").select("key", F.col("part").alias(k), F.row_number().over(turn).alias("nth"))
    others = rest(a, "a_part").join(rest(b, "b_part"), ["key", "nth"], "full_outer").select("key", "a_part", "b_part", F.lit(False).alias("same"))
    return equal.unionByName(others)


def is_resized(a: Column, b: Column) -> Column:
    """Whether two boxes differ by more than a tenth in width or height."""
    off = lambda lo, hi: F.abs((a[hi] - a[lo]) - (b[hi] - b[lo])) > RESIZED * F.greatest(a[hi] - a[lo], b[hi] - b[lo])
    return off("x0", "x1") | off("y0", "y1")


def pair_pages(best: DataFrame, pages: DataFrame) -> DataFrame:
    """(a, b, seq, a_page, b_page): new pages in order with the old page each chose, once each, and old pages that none
    has after the last pair with a smaller old page. `best` is (a, b, b_page, a_page); `pages` (a, b, a_pages, b_pages)."""
    every = pages.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("b_pages") - 1)).alias("b_page")).join(best.select("a", "b", "b_page", "a_page"), ["a", "b", "b_page"], "left")
    once = F.row_number().over(W.partitionBy("a", "b", "a_page").orderBy("b_page"))
    new = every.withColumn("a_page", F.when((F.col("a_page").isNotNull()) & (once == 1), F.col("a_page")))
    old = pages.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("a_pages") - 1)).alias("a_page")).join(new.select("a", "b", "a_page"), ["a", "b", "a_page"], "left_anti")
    pairs = new.where("a_page is not null").select("a", "b", F.col("a_page").alias("x"), F.col("b_page").alias("y"))
    after = old.join(pairs, ["a", "b"], "left").groupBy("a", "b", "a_page").agg(F.max(F.when(F.col("x") < F.col("a_page"), F.col("y"))).alias("y"))
    rows = new.select("a", "b", "a_page", "b_page", F.col("b_page").cast("double").alias("place")).unionByName(after.select("a", "b", "a_page", F.lit(None).cast("int").alias("b_page"), (F.coalesce(F.col("y"), F.lit(-1)) + 0.5).alias("place")))
    order = W.partitionBy("a", "b").orderBy("place", "a_page")
    return rows.select("a", "b", (F.row_number().over(order) - 1).cast("int").alias("seq"), "a_page", "b_page")


def in_series_order(pairs: DataFrame, similar: DataFrame) -> DataFrame:
    """(pair_id, a, b): pairs of a series of look-alikes in order: two that cross change partners where either caption is
    like the other's partner. Pairs: (pair_id, a, b); similar: (pair_id, a, b). A pair of versions is one row."""
    alike = similar.groupBy("pair_id").agg(F.collect_set(F.struct("a", "b")).alias("alike"))
    rows = pairs.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("pairs")).join(alike, "pair_id", "left")
    kind = pairs.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pair, own, near in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "pairs", "alike"))):
                a, b = [p["a"] for p in own], [p["b"] for p in own]
                like = {(s["a"], s["b"]) for s in near or []}
                for i, j in ((i, j) for i in range(len(a)) for j in range(i + 1, len(a))):
                    if b[i] > b[j] and (a[i], b[j]) in like and (a[j], b[i]) in like:
                        b[i], b[j] = b[j], b[i]
                out += zip([pair] * len(a), a, b)
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (batch.schema.field("pair_id").type, pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["pair_id", "a", "b"])

    return rows.select("pair_id", "pairs", "alike").mapInArrow(run, f"pair_id {kind}, a int, b int")
