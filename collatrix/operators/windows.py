"""Sequence operators as window functions: islands, bridged groups, as-of places, interpolation, forward fill."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Numbers runs of equal neighbouring values from 0: adds `island`."""
    line = W.partitionBy(*by).orderBy(*order)
    starts = (F.lag(value).over(line).isNull() & (F.row_number().over(line) == 1)) | ~F.col(value).eqNullSafe(F.lag(value).over(line))
    return rows.withColumn("_starts", starts.cast("int")).withColumn("island", (F.sum("_starts").over(line.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")).drop("_starts")


def bridged_groups(rows: DataFrame, by: Sequence[str], order: Sequence[str], edit: Column, weight: Column, most: int = 3) -> DataFrame:
    """Edits with their group: edits with up to `most` of weight between them belong together. Adds `group`."""
    line = W.partitionBy(*by).orderBy(*order)
    so_far = line.rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("_edit", edit).withColumn("_gap", F.sum(F.when(~F.col("_edit"), weight).otherwise(0)).over(so_far))
    edits = marked.where("_edit")
    starts = (F.col("_gap") - F.lag("_gap").over(line) > most) | F.lag("_gap").over(line).isNull()
    return edits.withColumn("group", (F.sum(starts.cast("int")).over(so_far) - 1).cast("int")).drop("_edit", "_gap")


def last_before(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column) -> Column:
    """The last value that is not null on an earlier row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))


def fill_forward(by: Sequence[str], order: Sequence[str], value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def interpolate(by: Sequence[str], order: Sequence[str], x: Column, y: Column) -> Column:
    """y at x on the line between the anchors (rows whose y is not null) around it; beside them, the nearest one's y."""
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*by).orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    anchor = F.when(y.isNotNull(), x)
    x0, y0 = F.last(anchor, ignorenulls=True).over(before), F.last(y, ignorenulls=True).over(before)
    x1, y1 = F.first(anchor, ignorenulls=True).over(after), F.first(y, ignorenulls=True).over(after)
    between = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return F.when(x0.isNull(), y1).when(x1.isNull() | (x1 == x0), y0).otherwise(between)


def rising_anchors(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, x, y): of each group's points the longest chain that rises in both, for scrolling one side by the other. Of
    points at one x the first counts. A group (the lines of a pair of documents) is one row."""
    from .alignment import rising_chain  # alignment reads this module too

    once = rows.groupBy(by, F.col(x).cast("double").alias("x")).agg(F.min(F.col(y).cast("double")).alias("y"))
    packed = once.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))
    kind = rows.schema[by].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, points in zip(batch.column(by).to_pylist(), batch.column("points").to_pylist()):
                out += [(key, points[k]["x"], points[k]["y"]) for k in rising_chain(np.array([p["y"] for p in points]))]
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (batch.schema.field(by).type, pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[by, x, y])

    return packed.mapInArrow(run, f"{by} {kind}, {x} double, {y} double")
