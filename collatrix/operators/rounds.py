"""Which version each round of a review was written on, and what became of the lines it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_token

# A quote on the cited lines, one within REACH lines, and what a round needs to be sure.
REACH, EXACT, NEAR = 3, 1.0, 0.5
LEAST_SCORE, LEAST_SHARE, ABSENT_SHARE, ABSENT_PROBES = 1.0, 0.3, 0.25, 2


def folded(text: str | Column) -> Column:
    """Normal form, lower case, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(normalize_token(text)), r"[^\p{L}\p{N}]+", " "))


def evidence(probes: DataFrame, lines: DataFrame) -> DataFrame:
    """(review_id, round, version, score): quotes of a round found where they are cited.

    Probes: (review_id, probe, round, first, last, snippet); lines: (review_id, version, num, text). A quote is sought in
    a line with the next one. Each probe meets the lines of its reach by number, so the join has as many rows as lines
    cited.
    """
    said = folded("snippet")
    wanted = probes.withColumn("said", said).where(F.length("said") >= 3)
    at = wanted.select("review_id", "probe", "round", "first", "last", "said", F.explode(F.sequence(F.col("first") - REACH, F.col("last") + REACH)).alias("num"))
    order = W.partitionBy("review_id", "version").orderBy("num")
    after = F.when(F.lead("num").over(order) == F.col("num") + 1, F.lead("one").over(order))
    numbered = lines.where("num is not null").withColumn("one", folded("text"))
    read = numbered.select("review_id", "version", "num", F.concat_ws(" ", F.col("one"), F.coalesce(after, F.lit(""))).alias("here"))
    found = at.join(read, ["review_id", "num"]).where(F.contains("here", "said"))
    worth = F.when(F.col("num").between(F.col("first"), F.col("last")), EXACT).otherwise(NEAR)
    best = found.groupBy("review_id", "round", "probe", "version").agg(F.max(worth).alias("worth"))
    return best.groupBy("review_id", "round", "version").agg(F.sum("worth").alias("score"))


def sure_rounds(probes: DataFrame, lines: DataFrame) -> DataFrame:
    """(review_id, round, version, known): rounds with clear evidence for a version, or that theirs is not here (null)."""
    counts = probes.where(F.length(folded("snippet")) >= 3).groupBy("review_id", "round").agg(F.count("*").alias("n"))
    place = W.partitionBy("review_id", "round").orderBy(F.desc("score"), "version")
    ranked = evidence(probes, lines).withColumn("place", F.row_number().over(place)).where("place <= 2")
    top = ranked.groupBy("review_id", "round").agg(
        F.max(F.when(F.col("place") == 1, F.col("score"))).alias("best"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)).alias("second"), F.max(F.when(F.col("place") == 1, F.col("version"))).alias("version")
    )
    rows = counts.join(top, ["review_id", "round"], "left").fillna({"best": 0.0, "second": 0.0})
    sure = (F.col("best") >= LEAST_SCORE) & (F.col("best") > F.col("second")) & (F.col("best") >= LEAST_SHARE * F.col("n"))
    absent = (F.col("n") >= ABSENT_PROBES) & (F.col("best") < ABSENT_SHARE * F.col("n"))
    return rows.where(sure | absent).select("review_id", "round", F.when(sure, F.col("version")).alias("version"))


def assign_rounds(rounds: DataFrame, sure: DataFrame, versions: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(review_id, round, version) for rounds (review_id, round) over versions (review_id, version, place from 0).

    A round without evidence takes the version after the one before it: as many places further as rounds without
    evidence lie between, if that is still before the next sure one. `chosen` (review_id, round, version) wins.
    """
    known = rounds.join(sure.withColumn("known", F.lit(True)), ["review_id", "round"], "left").join(versions, ["review_id", "version"], "left")
    order = W.partitionBy("review_id").orderBy("round")
    before, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    sized = known.join(versions.groupBy("review_id").agg(F.count("*").alias("n")), "review_id", "left")
    marked = sized.withColumns(
        {
            "last": F.coalesce(F.last("place", ignorenulls=True).over(before), F.lit(-1)),
            "run": F.sum(F.col("known").isNotNull().cast("int")).over(before),
            # The next round with evidence ends the run; where its version is not here, all later ones are open.
            "bound": F.first(F.when(F.col("known"), F.coalesce("place", F.col("n"))), ignorenulls=True).over(after),
        }
    )
    since = W.partitionBy("review_id", "run").orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    steps = F.sum(F.col("known").isNull().cast("int")).over(since)
    wanted = F.when(F.col("known"), F.col("place")).otherwise(F.when(F.col("last") + steps < F.coalesce("bound", "n"), F.col("last") + steps))
    placed = marked.withColumn("wanted", wanted).select("review_id", "round", F.col("wanted").alias("place"))
    out = placed.join(versions, ["review_id", "place"], "left").select("review_id", "round", "version")
    if chosen is None:
        return out
    own = chosen.select("review_id", "round", F.col("version").alias("own"), F.lit(True).alias("said"))
    return out.join(own, ["review_id", "round"], "left").select("review_id", "round", F.when(F.col("said"), F.col("own")).otherwise(F.col("version")).alias("version"))
