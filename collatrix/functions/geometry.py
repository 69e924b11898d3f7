"""Boxes (x0, y0, x1, y1) and 8 x 8 rasters as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def ordered_box(a: Column, b: Column, c: Column, d: Column) -> Box:
    """A box from two corners (a, b) and (c, d)."""
    return F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d)


def area(box: Box) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Box:
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def iou(a: Box, b: Box) -> Column:
    common = area(intersection(a, b))
    whole = area(a) + area(b) - common
    return F.when(whole > 0, common / whole).otherwise(0.0)


def contains(box: Box, x: Column, y: Column, slack: float = 0.0) -> Column:
    return (x >= box[0] - slack) & (x <= box[2] + slack) & (y >= box[1] - slack) & (y <= box[3] + slack)


def ink_ratio(a: Column, b: Column, paper: float, apart: float, least: float) -> Column:
    """Cells with ink in either raster that differ, over the cells with ink, `least` of them at least."""
    ink = lambda x, y: (x > paper) | (y > paper)
    both = F.zip_with(a, b, lambda x, y: F.struct(ink(x, y).alias("ink"), (F.abs(x - y) > apart).alias("apart")))
    inked = F.filter(both, lambda c: c["ink"])
    return F.size(F.filter(inked, lambda c: c["apart"])) / F.greatest(F.size(inked), F.lit(least))
