"""Comparison of figure panels as rasters: registration by shift and scale, then the share of ink that differs.

Images are float32 arrays of rows; paper is white (255). A panel pair is one row of a table, so panels spread over
tasks; the second look at close calls is another pass over the few rows that need it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the comparison.
LUMA = (0.299, 0.587, 0.114)
PAPER_IN_SHIFTS, PAPER_IN_INK, APART, LEAST_INK = 235, 225, 40, 50
COARSE, SEARCHED, GAIN = 120, 0.04, 0.01
SCALES, SCALE_STEPS = (0.9, 0.93, 0.96, 1.04, 1.07, 1.1), (0.015, 0.007, 0.003)
MISFIT, CLEAR_GAIN, SCALED_NOISE = 2, 0.8, 0.02
CHANGED, FINE_CHANGED = 0.01, 0.002
COMPARE_VERSION = 2


def planes(rgba: bytes, width: int, height: int) -> np.ndarray:
    """The colour planes over white paper: (3, height, width)."""
    data = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).astype(np.float64)
    alpha = data[:, :, 3:] / 255
    return (255 * (1 - alpha) + alpha * data[:, :, :3]).transpose(2, 0, 1).astype(np.float32)


def luminance(colours: np.ndarray) -> np.ndarray:
    return np.tensordot(np.array(LUMA), colours.astype(np.float64), 1).astype(np.float32)


def window_sum(image: np.ndarray) -> np.ndarray:
    """Sums over the 3 x 3 cells around each, as far as they exist."""
    wide = np.pad(image.astype(np.float64), 1)
    rows = wide[:-2] + wide[1:-1] + wide[2:]
    return rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]


def blurred(image: np.ndarray) -> np.ndarray:
    return (window_sum(image) / window_sum(np.ones_like(image))).astype(np.float32)


def reduced(image: np.ndarray, factor: int) -> np.ndarray:
    """Means of blocks; what doesn't fill a block at the far edges is left out."""
    height, width = max(1, image.shape[0] // factor), max(1, image.shape[1] // factor)
    cut = image[: height * factor, : width * factor]
    return cut.reshape(height, cut.shape[0] // height, width, cut.shape[1] // width).mean(axis=(1, 3), dtype=np.float64).astype(np.float32)


def overlap(a: np.ndarray, b: np.ndarray, dx: int, dy: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a on its grid of `step`, and those of b that lie dx, dy further, where both exist."""
    ys = np.arange(0, a.shape[0], step)
    xs = np.arange(0, a.shape[1], step)
    ys, xs = ys[(ys + dy >= 0) & (ys + dy < b.shape[0])], xs[(xs + dx >= 0) & (xs + dx < b.shape[1])]
    return a[np.ix_(ys, xs)], b[np.ix_(ys + dy, xs + dx)]


def misfit(a: np.ndarray, b: np.ndarray, dx: int, dy: int, step: int = 1) -> float:
    """Mean difference where either has ink."""
    x, y = overlap(a, b, dx, dy, step)
    ink = (x <= PAPER_IN_SHIFTS) | (y <= PAPER_IN_SHIFTS)
    return float(np.abs(x[ink].astype(np.float64) - y[ink]).mean()) if ink.any() else float("inf")


def least_misfit(a: np.ndarray, b: np.ndarray, around: tuple[int, int], radius: int, step: int) -> tuple[int, int, float]:
    best = (*around, misfit(a, b, *around, step))
    for dy in range(around[1] - radius, around[1] + radius + 1):
        for dx in range(around[0] - radius, around[0] + radius + 1):
            cost = misfit(a, b, dx, dy, step)
            if cost < best[2] - GAIN:
                best = (dx, dy, cost)
    return best


def coarse_shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float, int]:
    """(dx, dy, misfit, grid) of the best shift on a grid of about COARSE cells."""
    grid = max(1, max(a.shape[1], b.shape[1]) // COARSE)
    radius = max(2, int(np.ceil(SEARCHED * max(a.shape) / grid)))
    dx, dy, cost = least_misfit(reduced(a, grid), reduced(b, grid), (0, 0), radius, 1)
    return dx * grid, dy * grid, cost, grid


def best_shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    dx, dy, _, grid = coarse_shift(a, b)
    return least_misfit(a, b, (dx, dy), grid, max(1, max(a.shape) // 400))[:2]


def magnified(image: np.ndarray, scale: float) -> np.ndarray:
    """The image about its centre, white where nothing is left."""
    height, width = image.shape
    cy, cx = (height - 1) / 2, (width - 1) / 2
    y, x = cy + (np.arange(height) - cy) / scale, cx + (np.arange(width) - cx) / scale
    y0, x0 = np.clip(np.floor(y).astype(int), 0, height - 1), np.clip(np.floor(x).astype(int), 0, width - 1)
    y1, x1 = np.minimum(y0 + 1, height - 1), np.minimum(x0 + 1, width - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    rows = lambda r: image[np.ix_(r, x0)] * (1 - fx) + image[np.ix_(r, x1)] * fx
    out = rows(y0) * (1 - fy) + rows(y1) * fy
    inside = ((y >= 0) & (y <= height - 1))[:, None] & ((x >= 0) & (x <= width - 1))[None, :]
    return np.where(inside, out, 255).astype(np.float32)


class Registration:
    """How b lies on a's grid: a shift, and a scale only where that clearly fits better."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.shape, self.scale = a.shape, 1.0
        plain = coarse_shift(a, b)[2]
        if plain > MISFIT:
            self.cost = plain * CLEAR_GAIN
            for scale in SCALES:
                self._offer(a, b, scale)
            if self.scale != 1:
                for step in SCALE_STEPS:
                    for scale in (self.scale - step, self.scale + step):
                        self._offer(a, b, scale)
        self.dx, self.dy = best_shift(a, self._scaled(b))

    def _offer(self, a: np.ndarray, b: np.ndarray, scale: float) -> None:
        cost = coarse_shift(a, magnified(b, scale))[2]
        if cost < self.cost:
            self.cost, self.scale = cost, scale

    def _scaled(self, image: np.ndarray) -> np.ndarray:
        return image if self.scale == 1 else magnified(image, self.scale)

    def apply(self, image: np.ndarray) -> np.ndarray:
        source = self._scaled(image)
        out = np.full(self.shape, 255, np.float32)
        ys, xs = np.arange(self.shape[0]), np.arange(self.shape[1])
        ys, xs = ys[(ys + self.dy >= 0) & (ys + self.dy < source.shape[0])], xs[(xs + self.dx >= 0) & (xs + self.dx < source.shape[1])]
        out[np.ix_(ys, xs)] = source[np.ix_(ys + self.dy, xs + self.dx)]
        return out


def panel_difference(a: np.ndarray, b: np.ndarray) -> tuple[float, bool]:
    """(share of ink that differs, whether any does) for colour planes; another width or height is a whole difference."""
    (_, ha, wa), (_, hb, wb) = a.shape, b.shape
    if wa != wb or abs(ha - hb) > 0.03 * max(ha, hb) + 1:
        return 1.0, True
    lies = Registration(blurred(luminance(a)), blurred(luminance(b)))
    x = np.stack([blurred(c) for c in a])
    y = np.stack([lies.apply(blurred(c)) for c in b])
    reach = 1 if lies.scale == 1 else 2
    ink = ~((x > PAPER_IN_INK).all(axis=0) & (y > PAPER_IN_INK).all(axis=0))
    near = np.full(ink.shape, np.inf, np.float32)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            here = (slice(max(0, -dy), ha - max(0, dy)), slice(max(0, -dx), wa - max(0, dx)))
            there = (slice(max(0, dy), ha - max(0, -dy)), slice(max(0, dx), wa - max(0, -dx)))
            for p, q in ((x, y), (y, x)):
                near[here] = np.minimum(near[here], np.abs(p[(slice(None), *here)] - q[(slice(None), *there)]).max(axis=0))
    changed = int((ink & (near > APART)).sum())
    share = changed / max(int(ink.sum()), LEAST_INK)
    return (share if lies.scale == 1 else max(0.0, share - SCALED_NOISE)), changed > 0


PANEL = "key string, diff double, differs boolean, error string"


def compare_panels(pairs: DataFrame) -> DataFrame:
    """(key, diff, differs, error) for (key, a_rgba, a_width, a_height, b_rgba, b_width, b_height); a pair that can't be
    read has an error and no score, so that it stays unknown rather than changed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    a, b = (planes(row[f"{s}_rgba"], row[f"{s}_width"], row[f"{s}_height"]) for s in "ab")
                    out.append((row["key"], *panel_difference(a, b), None))
                except (ValueError, TypeError) as error:
                    out.append((row["key"], None, None, str(error)[:200]))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_(), pa.string()))], names=["key", "diff", "differs", "error"])

    return pairs.mapInArrow(run, PANEL)


def two_looks(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """(key, score, error): pairs that differ a little at first are judged at twice the width, on the first scale."""
    first = compare_panels(coarse)
    close = F.col("differs") & (F.col("diff") <= CHANGED)
    again = compare_panels(fine.join(first.where(close).select("key"), "key", "left_semi")).select("key", (F.col("diff") * CHANGED / FINE_CHANGED).alias("second"))
    return first.join(again, "key", "left").select("key", F.when(close & F.col("second").isNotNull(), F.col("second")).otherwise(F.col("diff")).alias("score"), "error")


def figure_verdicts(scores: DataFrame) -> DataFrame:
    """(figure, changed): by (figure, score, resized) rows of panels; a figure without panels, with an unknown or high
    score, or of another size has changed."""
    return scores.groupBy("figure").agg(F.bool_or(F.col("score").isNull() | (F.col("score") > CHANGED) | F.col("resized")).alias("changed"))
