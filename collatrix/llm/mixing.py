"""Mixing sources to target weights with DataFrame functions only.

Token counts are aggregated by source (map-side first, so a source with a third of all rows is one partial sum a
task). Targets come from water filling on the small table of sources: the level at which shares by weight, held under
each source's ceiling, add up to the total. Each document is then emitted floor(rate) times, and once more if a hash
of its id falls below the fraction.

Defined results: null text counts as empty (size 0); a null source is a source of its own, ordered last; repeated
rows are documents of their own with equal decisions; a source without words has target 0 and rate 0; an empty table
gives an empty result. In `mix`, columns of the input whose names clash with result columns are replaced by the results;
`emit` returns the input's columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, checkpointed, renamed, text_or_empty

#: Sources, a short row each, that are broadcast at most; more are joined by shuffle.
MOST_SOURCES = 1 << 16
RESULT_COLUMNS = ("size", "source_size", "target", "rate", "copies", "taken")


def word_count(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], most_epochs: float) -> DataFrame:
    """`sizes` (source, source_size) with the target of each source.

    With ceilings c = most_epochs * size, target = min(c, level * weight). Sources are put in the order of c / weight;
    the first k of them are full at the level that the rest would have, and the least k whose level the next source
    does not exceed is the answer. Two running sums give every k at once.
    """
    by_code_point = W.orderBy(F.col("source").asc_nulls_last())
    full_first = W.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full_first.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_code_point) - 1)
        .withColumn("weight", weight)
        .withColumn("ceiling", F.lit(float(most_epochs)) * F.col("source_size"))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("full_size", F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
        .withColumn("full_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level_here", (F.col("all_size") - F.col("full_size")) / (F.col("all_weight") - F.col("full_weight")))
        .withColumn("fits", F.col("level_here") * F.col("weight") <= F.col("ceiling"))
    )
    level = F.min(F.when(F.col("fits"), F.struct("full_weight", "level_here"))).over(everything)["level_here"]
    return (
        ranked.withColumn("level", level)
        .withColumn("target", F.least(F.col("ceiling"), F.coalesce(F.col("level") * F.col("weight"), F.col("ceiling"))))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most_epochs)))).otherwise(0.0))
        .select("source", "source_size", "target", "rate")
    )


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of seed and key: reruns and other engines agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def decided(sized: DataFrame, weights: Sequence[float], most_epochs: float, seed: int) -> DataFrame:
    """`sized` (…, _id, _source, _size) with _source_size, _target, _rate and _copies."""
    sizes = checkpointed(sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")))
    rates = source_targets(sizes, weights, most_epochs).toDF("_named", "_source_size", "_target", "_rate")
    known = F.broadcast(rates) if sizes.count() <= MOST_SOURCES else rates
    joined = sized.join(known, F.col("_source").eqNullSafe(F.col("_named"))).drop("_named")
    extra = (unit_hash(F.col("_id"), seed) < F.col("_rate") - F.floor("_rate")).cast("int")
    return joined.withColumn("_copies", F.floor("_rate").cast("int") + extra)


def _sized(docs: DataFrame, keep: Sequence[str], id_column: str, text_column: str, source_column: str) -> tuple[DataFrame, list[str]]:
    columns, own = renamed(docs, list(keep))
    return docs.select(*columns, F.col(id_column).alias("_id"), F.col(source_column).alias("_source"), word_count(text_column).alias("_size")), own


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    most_epochs: float = 3,
    seed: int = 17,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The `keep` columns of every document with its size, its source's size and target, and the copies that the mix takes."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT_COLUMNS]
    sized, own = _sized(docs, keep, id_column, text_column, source_column)
    # Without the texts rows are short: they are counted once and kept, not read again for the sums.
    made = decided(sized if text_column in keep else checkpointed(sized), weights, most_epochs, seed)
    results = [F.col(f"_{c}").alias(c) for c in RESULT_COLUMNS[:-1]]
    return made.select(*(F.col(n).alias(c) for c, n in zip(keep, own)), *results, (F.col("_size") * F.col("_copies")).alias("taken"))


def emit(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most_epochs: float = 3, seed: int = 17, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mixed corpus: each document, as it came, as many times as its copies."""
    sized, own = _sized(docs, docs.columns, id_column, text_column, source_column)
    made = decided(sized, weights, most_epochs, seed).where("_copies > 0")
    repeated = made.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, own)))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, 3.0::DOUBLE * source_size AS ceiling FROM sizes
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM placed
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER before, 0.0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level_here,
         coalesce(sum(weight) OVER before, 0.0) AS full_weight
  FROM weighed
  WINDOW before AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), settled AS (
  SELECT *, (SELECT arg_min(level_here, full_weight) FROM levels WHERE level_here * weight <= ceiling) AS level FROM levels
), rates AS (
  SELECT source, source_size, CAST(least(ceiling, coalesce(level * weight, ceiling)) AS DOUBLE) AS target FROM settled
), joined AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
         CASE WHEN r.source_size > 0 THEN least(r.target / r.source_size, 3.0) ELSE 0.0 END AS rate
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate)
         + CASE WHEN CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS UBIGINT)
                     / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM joined
"""
