"""From positioned text to lines: pieces, body geometry, line numbers, text outside figures, rows, words and lines.

Tables, all with doc_id and page: items (seq, str, transform, width, font, ascent, descent), page_sizes (width, height,
viewport), pieces (seq, text, x0, x1, base, size, top, bottom, space_before, font), graphics and rules (x0, y0, x1, y1), marks
(base, num). Lengths are points, y grows downwards. What looks at neighbours or at a whole document is windows and
aggregates; only rows and words of a page, where a row grows while it is read, are a function of one page's pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normal_token, round_half_up

PAGE = ("doc_id", "page")

# Advance widths of characters in em, and the width of all others.
WIDTHS = {
    **dict.fromkeys("abdghnopquvxy0123456789$/^_~\\{}*\"", 0.53),
    **dict.fromkeys("ceksz", 0.44),
    **dict.fromkeys("fjrt", 0.36),
    **dict.fromkeys("il.,:;!|'[]", 0.278),
    "m": 0.833,
    "w": 0.722,
    **dict.fromkeys("()", 0.389),
    "-": 0.333,
    "?": 0.472,
    **dict.fromkeys("ABDEFGHKLNOPQRTUVXYZCJ", 0.74),
    "I": 0.361,
    "M": 0.917,
    "W": 1.028,
    "S": 0.556,
    **dict.fromkeys("=+<>%&#@", 0.778),
    " ": 0.333,
}
OTHER_WIDTH, ASCENT, DESCENT = 0.6, 0.75, 0.25
# How flat upright text is, glyphs of a sideways page, graphics that are kept, text that belongs to figures.
FLAT, LEAST_SIDEWAYS = 1e-3, 50
LEAST_AREA, MOST_AREA_SHARE = 400, 0.8
LEAST_PLOT_GLYPHS, NEAR_GRAPHIC, SMALL_FONT, HUGGING = 5, 60, 0.8, 12
# A column of line numbers has so many, and this share of steps of one.
LEAST_NUMBERS, LEAST_STEPS = 15, 0.6


# ---------------------------------------------------------------------------------------------- items to pieces


def on_screen(transform: Column, viewport: Column) -> list[Column]:
    """The six numbers of a text transform followed by the page's viewport transform."""
    a, v = ([F.get(m, i) for i in range(6)] for m in (transform, viewport))
    pairs = [a[i] * v[j] + a[i + 1] * v[2 + j] for i in (0, 2, 4) for j in (0, 1)]
    return [*pairs[:4], pairs[4] + v[4], pairs[5] + v[5]]


def sideways_turns(items: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """(doc_id, page, turn): the transform that makes a sideways page upright, null where most text reads left to right."""
    m = on_screen(F.col("transform"), F.col("viewport"))
    rows = items.select(*PAGE, "str", "transform").join(page_sizes, list(PAGE)).select(*PAGE, "width", "height", F.length(F.regexp_replace("str", r"\s", "")).alias("n"), m[0].alias("across"), m[1].alias("down"))
    size = F.sqrt(F.col("across") ** 2 + F.col("down") ** 2)
    turned = (size > 0) & (F.abs("across") <= FLAT * size)
    count = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    sums = rows.groupBy(*PAGE).agg(F.first("height").alias("height"), F.first("width").alias("width"), count(~turned & (F.col("across") > 0)).alias("upright"), count(turned & (F.col("down") < 0)).alias("up"), count(turned & (F.col("down") >= 0)).alias("falling"))
    numbers = lambda *v: F.array(*[(F.lit(float(x)) if isinstance(x, int) else x.cast("double")) for x in v])
    turn = F.when(F.col("up") >= F.col("falling"), numbers(0, 1, -1, 0, F.col("height"), 0)).otherwise(numbers(0, -1, 1, 0, 0, F.col("width")))
    return sums.select(*PAGE, F.when(F.greatest("up", "falling") >= F.greatest(F.lit(LEAST_SIDEWAYS), F.col("upright")), turn).alias("turn"))


def turned_back(box: Column, turn: Column) -> Column:
    """A box of a turned page as the page is displayed; other boxes as they are."""
    a, b, c, d, e, f = (F.get(turn, i) for i in range(6))
    # The inverse of a turn by a right angle is its transpose.
    at = lambda x, y: ((x - e) * a + (y - f) * b, (x - e) * c + (y - f) * d)
    (p, q), (r, s) = at(box["x0"], box["y0"]), at(box["x1"], box["y1"])
    back = F.struct(F.least(p, r).alias("x0"), F.least(q, s).alias("y0"), F.greatest(p, r).alias("x1"), F.greatest(q, s).alias("y1"))
    return F.when(turn.isNull(), box).otherwise(back)


RUN = T.StructType([T.StructField("x0", T.DoubleType()), T.StructField("x1", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("first", T.BooleanType())])


@F.arrow_udf(T.ArrayType(RUN))
def _runs(text: pa.Array, x: pa.Array, width: pa.Array) -> pa.Array:
    """The runs without white space of each text, where they lie, and whether they begin it."""
    out = []
    for s, left, wide in zip(text.to_pylist(), x.to_pylist(), width.to_pylist()):
        edges = np.cumsum([0.0, *(WIDTHS.get(c, OTHER_WIDTH) for c in s)])
        at = left + edges / (edges[-1] or 1.0) * wide
        out.append([{"x0": at[m.start()], "x1": at[m.end()], "text": m[0], "first": m.start() == 0} for m in re.finditer(r"\S+", s)])
    return pa.array(out, pa.list_(pa.struct([("x0", pa.float64()), ("x1", pa.float64()), ("text", pa.string()), ("first", pa.bool_())])))


def pieces_of(items: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Pieces without white space, with estimated boxes. Rotated and mirrored text is skipped.

    A piece has a space before it if its item has, or if the item before ends with one or is blank or skipped.
    """
    m = on_screen(F.col("transform"), F.col("viewport"))
    size = F.sqrt(m[2] ** 2 + m[3] ** 2)
    skew = (size == 0) | (F.abs(m[1]) > FLAT * size) | (F.abs(m[2]) > FLAT * size) | (m[0] <= 0) | (m[3] >= 0)
    scale = F.sqrt(F.get("viewport", F.lit(0)) ** 2 + F.get("viewport", F.lit(1)) ** 2)
    shown = items.where(F.length("str") > 0).join(page_sizes.select(*PAGE, "viewport"), list(PAGE)).select(
        *PAGE, "seq", "str", "font", m[4].alias("x"), m[5].alias("base"), size.alias("size"), (F.col("width") * scale).alias("width"), (skew | ~F.col("str").rlike(r"\S")).alias("silent"),
        F.when(F.col("ascent") > 0, F.col("ascent")).otherwise(ASCENT).alias("ascent"), F.when(F.col("descent") < 0, -F.col("descent")).otherwise(DESCENT).alias("descent"),
    )
    before = W.partitionBy(*PAGE).orderBy("seq")
    pending = F.coalesce(F.lag(F.col("silent") | F.col("str").rlike(r"\s$")).over(before), F.lit(True))
    runs = shown.withColumn("pending", pending).where(~F.col("silent")).withColumn("run", _runs("str", "x", "width"))
    spread = runs.select("*", F.posexplode("run").alias("nth", "r"))
    spaced = (F.col("nth") > 0) | ~F.col("r.first") | F.col("pending")
    return spread.select(
        *PAGE, (F.col("seq") * 1000 + F.col("nth")).cast("long").alias("seq"), "r.text", "r.x0", "r.x1", "base", "size", (F.col("base") - F.col("ascent") * F.col("size")).alias("top"),
        (F.col("base") + F.col("descent") * F.col("size")).alias("bottom"), spaced.alias("space_before"), "font",
    )


# ---------------------------------------------------------------------------------------------- body and line numbers


def mode_of(rows: DataFrame, by: list[str], order: list[str], value: Column, step: float, name: str) -> DataFrame:
    """(by, name): the most frequent value rounded to `step`; of equals the one that was so frequent first."""
    rounded = rows.select(*by, *order, (round_half_up(value / step) * step).alias(name))
    nth = rounded.withColumn("_nth", F.row_number().over(W.partitionBy(*by, name).orderBy(*order)))
    first = W.partitionBy(*by).orderBy(F.desc("_nth"), *order)
    return nth.withColumn("_place", F.row_number().over(first)).where("_place = 1").select(*by, name)


def body_geometry(pieces: DataFrame) -> DataFrame:
    """(doc_id, body_size, body_left, body_right): the commonest size of pieces of three characters, and the edges of
    text of that size; right edges lie 200 points from the left one at least."""
    order = ["page", "seq"]
    size = mode_of(pieces.where(F.length("text") > 2), ["doc_id"], order, F.col("size"), 0.1, "body_size")
    main = pieces.join(size, "doc_id").where(F.abs(F.col("size") - F.col("body_size")) < 0.5)
    left = mode_of(main, ["doc_id"], order, F.col("x0"), 1, "body_left")
    wide = main.join(left, "doc_id").where(F.col("x1") > F.col("body_left") + 200)
    return size.join(left, "doc_id", "left").join(mode_of(wide, ["doc_id"], order, F.col("x1"), 1, "body_right"), "doc_id", "left").fillna(0.0)


def number_candidates(pieces: DataFrame, body: DataFrame) -> DataFrame:
    """Pieces of digits in a margin, once for each of their edges: side (L or R), edge (0 or 1) and bucket of two points."""
    digits = pieces.where(F.col("text").rlike(r"^[0-9]{1,5}$")).join(body, "doc_id")
    side = F.when(F.col("x1") < F.col("body_left") - 2, "L").when(F.col("x0") > F.col("body_right") + 2, "R")
    edges = F.array(F.struct(F.lit(0).alias("edge"), F.col("x0").alias("x")), F.struct(F.lit(1).alias("edge"), F.col("x1").alias("x")))
    spread = digits.withColumn("side", side).where("side is not null").select(*PAGE, "seq", "base", F.col("text").cast("int").alias("num"), "side", F.explode(edges).alias("e"))
    return spread.select(*PAGE, "seq", "base", "num", "side", F.col("e.edge").alias("edge"), round_half_up(F.col("e.x") / 2).alias("bucket"))


def steady_columns(candidates: DataFrame, by: list[str], column: list[str], order: list[str]) -> DataFrame:
    """(by, column, n, steps) of the column of numbers with most steps of one, if most of its steps are: at most one for
    each `by`. Of equals the one with the least names wins."""
    line = W.partitionBy(*by, *column).orderBy(*order)
    follows = (F.col("num") - F.lag("num").over(line) == 1).cast("int")
    sums = candidates.withColumn("_step", follows).groupBy(*by, *column).agg(F.count("*").alias("n"), F.coalesce(F.sum("_step"), F.lit(0)).cast("long").alias("steps"))
    sure = sums.where((F.col("n") >= LEAST_NUMBERS) & (F.col("steps") >= LEAST_STEPS * (F.col("n") - 1)))
    best = W.partitionBy(*by).orderBy(F.desc("steps"), *column) if by else W.orderBy(F.desc("steps"), *column)
    return sure.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def line_marks(pieces: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, page, seq, base, num) of the line numbers: the winning column and the buckets beside it."""
    found = number_candidates(pieces, body)
    won = steady_columns(found, ["doc_id"], ["side", "edge", "bucket"], ["page", "base", "seq"]).select("doc_id", "side", "edge", F.col("bucket").alias("won"))
    near = found.join(won, ["doc_id", "side", "edge"]).where(F.abs(F.col("bucket") - F.col("won")) <= 1)
    return near.groupBy(*PAGE, "seq").agg(F.first("base").alias("base"), F.first("num").alias("num"))


# ---------------------------------------------------------------------------------------------- text outside figures


def kept_graphics(graphics: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Graphics that are neither specks nor as large as the page."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    sized = graphics.join(page_sizes.select(*PAGE, (F.col("width") * F.col("height")).alias("_page_area")), list(PAGE))
    return sized.where((area >= LEAST_AREA) & (area <= MOST_AREA_SHARE * F.col("_page_area"))).drop("_page_area")


def text_pieces(pieces: DataFrame, graphics: DataFrame, marks: DataFrame, body: DataFrame) -> DataFrame:
    """Pieces of running text: no line numbers, nothing inside a graphic, no font of plots near one, no small print that
    hugs one. A font of plots has five pieces inside graphics, more than outside, and none far from them."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    boxes = graphics.select(*PAGE, *[F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")])
    within = lambda pad: (cx >= F.col("g_x0") - pad) & (cx <= F.col("g_x1") + pad) & (cy >= F.col("g_y0") - pad) & (cy <= F.col("g_y1") + pad)
    hugs = (cx >= F.col("g_x0")) & (cx <= F.col("g_x1")) & (((cy < F.col("g_y0")) & (cy >= F.col("g_y0") - HUGGING)) | ((cy > F.col("g_y1")) & (cy <= F.col("g_y1") + HUGGING)))
    any_ = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    # A page's pieces meet its own graphics only.
    seen = pieces.join(boxes, list(PAGE), "left").groupBy(*PAGE, "seq").agg(any_(within(1)).alias("inside"), any_(within(NEAR_GRAPHIC)).alias("near"), any_(hugs).alias("hugs"))
    placed = pieces.join(seen, [*PAGE, "seq"]).join(body.select("doc_id", "body_size"), "doc_id")
    fonts = placed.groupBy(*PAGE, "font").agg(F.count_if("inside").alias("n_in"), F.count_if(~F.col("inside")).alias("n_out"), F.count_if(~F.col("inside") & ~F.col("near")).alias("n_far"))
    plots = fonts.where((F.col("n_in") >= LEAST_PLOT_GLYPHS) & (F.col("n_in") > F.col("n_out")) & (F.col("n_far") == 0)).select(*PAGE, "font", F.lit(True).alias("plot"))
    told = placed.join(plots, [*PAGE, "font"], "left").join(marks.select(*PAGE, "seq", F.lit(True).alias("mark")), [*PAGE, "seq"], "left")
    out = F.col("inside") | F.col("mark").isNotNull() | (F.col("plot").isNotNull() & F.col("near")) | (F.col("hugs") & (F.col("size") <= SMALL_FONT * F.col("body_size")))
    return told.where(~out).select(*pieces.columns)


# ---------------------------------------------------------------------------------------------- rows, words and lines

# Rows are as high, scripts as far and as small, gaps as wide as this, in points or sizes.
ROW_HEIGHT, SCRIPT_SIZE, SCRIPT_REACH, LEVEL_REACH, FOLD_REACH = 0.8, 0.85, 0.62, 0.3, 0.6
TEXT_CHARS, FEW_CHARS, BODY_SHARE = 20, 8, 0.9
WORD_GAP, MARK_SIZE, MARK_RAISE, RADICAL = 0.25, 0.8, 0.2, 0.72
SENTENCE_END, MARK = re.compile(r"[a-z]{4}$|[.,;:]$"), re.compile(r"[0-9]{1,2}")


class Pieces:
    """The pieces of one page as arrays."""

    def __init__(self, text: list[str], x0, x1, base, size, top, bottom, space) -> None:
        self.text = text
        self.x0, self.x1, self.base, self.size, self.top, self.bottom = (np.array(v, np.float64) for v in (x0, x1, base, size, top, bottom))
        self.space = np.array(space, bool)
        # A radical sign hangs from its top: it goes down to what it is drawn over.
        lowered = np.where([t.startswith("√") for t in text], RADICAL * self.size, 0.0) if text else 0.0
        self.base, self.top, self.bottom = self.base + lowered, self.top + lowered, self.bottom + lowered
        self.chars = np.array([len(t) for t in text], np.int64)


class Row:
    """Pieces that share a baseline: the first one's."""

    def __init__(self, page: Pieces, at: list[int]) -> None:
        self.at, self.base = list(at), float(page.base[at[0]])
        self.size, self.x0, self.x1 = float(page.size[at].max()), float(page.x0[at].min()), float(page.x1[at].max())


def rows_of(page: Pieces, at: np.ndarray) -> list[Row]:
    """Rows of the pieces `at`, from top to bottom: each takes what lies within its height of its first piece."""
    order = at[np.lexsort((page.x0[at], page.base[at]))]
    rows, start = [], 0
    while start < len(order):
        end = start + int(np.searchsorted(page.base[order[start:]] - page.base[order[start]], ROW_HEIGHT, "right"))
        rows.append(Row(page, order[start:end].tolist()))
        start = end
    return rows


def numbered_rows(rows: list[Row], marks: list[tuple[float, int]]) -> dict[int, int]:
    """Which rows carry a line number. A mark takes the largest print in its reach, of about equal ones the nearest, and
    a row its first mark."""
    found: dict[int, int] = {}
    for base, num in marks:
        best = None
        for k, r in enumerate(rows):
            if abs(base - r.base) <= max(2.0, LEVEL_REACH * r.size) and (best is None or r.size > rows[best].size + 0.5 or (abs(r.size - rows[best].size) <= 0.5 and abs(base - r.base) < abs(base - rows[best].base))):
                best = k
        if best is not None:
            found.setdefault(best, num)
    return found


def nearest(distance: np.ndarray, open_: np.ndarray) -> int:
    """The place of the least distance among the open ones, -1 if none is."""
    reachable = np.where(open_, distance, np.inf)
    return int(reachable.argmin()) if open_.any() else -1


def attached(page: Pieces, rows: list[Row], main: list[int]) -> list[int]:
    """Gives loose pieces, from left to right, to the nearest main row in reach, which grows by them; returns the rest."""
    loose = sorted((p for k, r in enumerate(rows) if k not in set(main) for p in r.at), key=lambda p: page.x0[p])
    if not main:
        return loose
    base, size, x0, x1 = (np.array([getattr(rows[k], name) for k in main]) for name in ("base", "size", "x0", "x1"))
    rest = []
    for p in loose:
        distance = np.abs(page.base[p] - base)
        limit = np.where(page.size[p] <= SCRIPT_SIZE * size, SCRIPT_REACH, LEVEL_REACH) * size
        k = nearest(distance, (distance <= limit) & (page.x0[p] >= x0 - size) & (page.x0[p] <= x1 + size))
        if k < 0:
            rest.append(p)
        else:
            rows[main[k]].at.append(p)
            x1[k] = max(x1[k], page.x1[p])
    return rest


def folded_rows(rows: list[Row]) -> list[Row]:
    """Rows of smaller print joined to a bigger row they stand at, the smallest first."""
    gone: set[int] = set()
    for k in sorted(range(len(rows)), key=lambda k: rows[k].size):
        own = rows[k]
        reach = [(abs(own.base - n.base), j) for j, n in enumerate(rows) if j != k and j not in gone and own.size <= SCRIPT_SIZE * n.size and abs(own.base - n.base) <= FOLD_REACH * n.size and own.x0 >= n.x0 - FOLD_REACH * n.size and own.x1 <= n.x1 + FOLD_REACH * n.size]
        if reach:
            n = rows[min(reach, key=lambda r: r[0])[1]]
            n.at += own.at
            n.x0, n.x1 = min(n.x0, own.x0), max(n.x1, own.x1)
            gone.add(k)
    return [r for k, r in enumerate(rows) if k not in gone]


def is_mark(page: Pieces, p: int, beside: int) -> bool:
    """A raised number of one or two digits, smaller than the piece beside it."""
    return MARK.fullmatch(page.text[p]) is not None and page.size[p] < MARK_SIZE * page.size[beside] and page.base[p] < page.base[beside] - MARK_RAISE * page.size[beside]


def words_of(page: Pieces, at: list[int]) -> list[tuple[str, tuple[float, float, float, float], bool]]:
    """(text, box, whether it is a footnote mark) of the words of a row: they end at a space, a clear gap or a mark."""
    order = sorted(at, key=lambda p: page.x0[p])
    groups: list[list[int]] = []
    notes: list[bool] = []
    for p in order:
        note = False
        if groups:
            own = groups[-1]
            after = is_mark(page, p, own[-1]) and SENTENCE_END.search("".join(page.text[q] for q in own)) is not None
            before = len(own) == 1 and is_mark(page, own[0], p) and page.text[p][:1].isascii() and page.text[p][:1].isalpha()
            notes[-1] |= before
            near = page.x0[p] - page.x1[own].max() < WORD_GAP * max(page.size[own].max(), page.size[p])
            if near and not (page.space[p] or after or before):
                own.append(p)
                continue
            note = after
        groups.append([p])
        notes.append(note)
    box = lambda g: (float(page.x0[g].min()), float(page.top[g].min()), float(page.x1[g].max()), float(page.bottom[g].max()))
    return [(word_text(page, g), box(g), n) for g, n in zip(groups, notes)]


def word_text(page: Pieces, at: list[int]) -> str:
    """The text of a word. Scripts that stand over each other are read run by run: "+0.31" before "-0.27"."""
    runs: list[list[int]] = []
    for p in at:
        own = next((r for r in runs if abs(page.base[r[0]] - page.base[p]) < 0.5 and abs(page.x0[p] - page.x1[r].max()) < 0.3 * page.size[p] + 1e-9), None)
        if own is None:
            runs.append([p])
        else:
            own.append(p)
    if len(runs) < 2:
        return "".join(page.text[p] for p in at)
    base, size = page.base[[r[0] for r in runs]], page.size[[r[0] for r in runs]]
    left, right = (np.array([f(r) for r in runs]) for f in (lambda r: page.x0[r[0]], lambda r: page.x1[r].max()))
    shared = np.minimum(right[:, None], right) - np.maximum(left[:, None], left)
    narrow = np.minimum((right - left)[:, None], right - left)
    stacked = (np.abs(base[:, None] - base) > 0.3 * np.minimum(size[:, None], size)) & (shared > 0.5 * narrow)
    start = left.copy()
    for i, j in np.argwhere(stacked):
        start[i] = start[j] = min(start[i], start[j])
    # What starts first leads its stack, on a tie the upper one.
    order = sorted(range(len(runs)), key=lambda k: (start[k], round(left[k], 1), base[k]))
    return "".join(page.text[p] for k in order for p in runs[k])


def lines_of_page(page: Pieces, marks: list[tuple[float, int]], body_size: float) -> list[tuple]:
    """(base, size, num, words) of each line, from top to bottom. Rows with a line number or a fair amount of text that
    aren't scripts of a numbered one are lines; scripts join the line they stand at."""
    rows = rows_of(page, np.arange(len(page.text)))
    numbers = numbered_rows(rows, marks)

    def textual(r: Row) -> bool:
        n = int(page.chars[r.at].sum())
        return n >= TEXT_CHARS or (n >= FEW_CHARS and bool((page.size[r.at] >= BODY_SHARE * body_size).any()))

    def script(r: Row) -> bool:
        return any(rows[k] is not r and r.size <= SCRIPT_SIZE * rows[k].size and abs(r.base - rows[k].base) <= SCRIPT_REACH * rows[k].size for k in numbers)

    main = [k for k, r in enumerate(rows) if k in numbers or (textual(r) and not script(r))]
    nums = {id(rows[k]): num for k, num in numbers.items()}
    rest = attached(page, rows, main)
    found = [rows[k] for k in main] + folded_rows(rows_of(page, np.array(rest, np.int64)))
    return [(r.base, r.size, nums.get(id(r)), words_of(page, r.at)) for r in sorted(found, key=lambda r: r.base)]


BOX = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
WORD = pa.list_(pa.struct([("text", pa.string()), ("norm", pa.string()), ("box", BOX), ("note", pa.bool_())]))
LINES = "doc_id string, page int, line_no int, num int, base double, size double, box struct<x0:double,y0:double,x1:double,y1:double>, text string, words array<struct<text:string,norm:string,box:struct<x0:double,y0:double,x1:double,y1:double>,note:boolean>>"
NOTE = "#fn"


def build_lines(pieces: DataFrame, marks: DataFrame, body: DataFrame) -> DataFrame:
    """The lines of every page with their words. A page's pieces are one group: as many as a page has."""
    rows = pieces.select(*PAGE, "text", "x0", "x1", "base", "size", "top", "bottom", "space_before", "seq").join(body.select("doc_id", "body_size"), "doc_id")
    numbered = marks.toDF(*marks.columns).select(*(F.col(c).alias(c) for c in (*PAGE, "base", "num")))  # marks come of pieces too

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("seq")
        page = Pieces(*(left[c].to_pylist() for c in ("text", "x0", "x1", "base", "size", "top", "bottom", "space_before")))
        found = lines_of_page(page, sorted(zip(right["base"].to_pylist(), right["num"].to_pylist())), left["body_size"][0].as_py()) if left.num_rows else []
        out: dict[str, list] = {c: [] for c in ("page", "line_no", "num", "base", "size", "box", "text", "words")}
        for n, (base, size, num, words) in enumerate(found):
            boxes = np.array([b for _, b, _ in words])
            box = dict(zip(("x0", "y0", "x1", "y1"), (*boxes[:, :2].min(axis=0).tolist(), *boxes[:, 2:].max(axis=0).tolist())))
            told = [{"text": t, "norm": NOTE if note else normal_token(t), "box": dict(zip(("x0", "y0", "x1", "y1"), b)), "note": bool(note)} for t, b, note in words]
            for c, v in zip(out, (key[1].as_py(), n, num, base, size, box, " ".join(t for t, _, _ in words), told)):
                out[c].append(v)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), BOX, pa.string(), WORD)
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.string()), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["doc_id", *out])

    return rows.groupBy(*PAGE).cogroup(numbered.groupBy(*PAGE)).applyInArrow(run, LINES)


def lines_of_documents(items: DataFrame, page_sizes: DataFrame, graphics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, body geometry, marks) of documents from their text items: the whole chain. Sideways pages are read in
    their turned frame (`sideways_turns` has it, `turned_back` maps boxes back)."""
    turns = sideways_turns(items, page_sizes)
    upright = page_sizes.join(turns, list(PAGE), "left").withColumn(
        "viewport", F.when(F.col("turn").isNull(), F.col("viewport")).otherwise(F.array(*_followed(F.col("viewport"), F.col("turn"))))
    )
    pieces = pieces_of(items, upright)
    body = body_geometry(pieces)
    marks = line_marks(pieces, body)
    text = text_pieces(pieces, kept_graphics(graphics, page_sizes), marks, body)
    return build_lines(text, marks, body), body, marks


def _followed(first: Column, second: Column) -> list[Column]:
    return on_screen(first, second)


def median(column: str) -> Column:
    """Aggregate: the value in the middle, of two the greater."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")
