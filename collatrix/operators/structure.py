"""The structure of lines: headers, footers, contents, footnotes, captions, figures, tables, equations and sections.

Tables, all with doc_id and page: lines as `layout.build_lines` makes them, page_sizes (width, height), graphics (graphic, x0,
y0, x1, y1, hash), rules (x0, y0, x1, y1), outline (entry, title, level, y). Each step takes lines with their kind so
far and settles more of them; a line that carries a number of its own is running text and stays body. Groups of lines are
islands of neighbours, regions are ranges of a page; all of it is joins and windows within a page or document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import CAPTION, caption_kind, caption_number, digit_skeleton, normalize_token, round_half_up, squash
from ..sources.lineage import cut
from .layout import NOTE, PAGE

# Page edges and how often a line recurs there, small print, distances in points or sizes.
TOP, BOTTOM, BASE_STEP, LEAST_PAGES, PAGES_SHARE = 0.12, 0.85, 3, 3, 0.3
NOTE_SIZE, CAPTION_SIZE, CAPTION_GAP, NEAR_CAPTION, GRAPHIC_SLACK = 0.92, 0.97, 1.6, 60, 6
RULE_REACH, RULE_GAP, RULE_SLACK, SCRIPT_ROW, COLUMN_GAP, MERGE_GAP = 120, 250, 2, 0.85, 2, 10
EQUATION_EDGE, EQUATION_INDENT, EQUATION_GAP = 8, 15, 1.8
HEADING_SIZE, OUTLINE_ABOVE, OUTLINE_BELOW, TITLE_CHARS = 1.15, 4, 80, 24
# Patterns of page numbers, contents, equation and section numbers.
PAGE_NUMBER, LEADER, CONTENTS = r"(?i)^([ivxlc]+|[0-9]+)$", r"(\.\s?){5,}", (r"\s[0-9]+$", r"^([A-Z]|[0-9]+)(\.[0-9]+)*\s")
EQUATION_NUMBER = r"^\(((?:[A-Z]\.)?[0-9]+[a-z]?)\)[.,]?$"
SECTION_START, SECTION_NUMBER = r"^((?:[A-Z]|[0-9]+)(?:\.[0-9]+)*)\s+(\S.*)$", r"^(?:[A-Z]|[0-9]+)(?:\.[0-9]+)*\.?$"
BOX = ("x0", "y0", "x1", "y1")
LINE = ("doc_id", "page", "line_no")


def flat(lines: DataFrame) -> DataFrame:
    """Lines with the columns that structure is read from: box edges, first and last word, whether they have columns."""
    gaps = F.zip_with(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), lambda right, left: right["box"]["x0"] - left["box"]["x1"])
    last = F.element_at("words", -1)
    return lines.select(
        *LINE, "num", "base", "size", *[F.col("box")[c].alias(c) for c in BOX], "text", normalize_token("text").alias("norm"), F.get("words", F.lit(0))["text"].alias("first_text"),
        F.get("words", F.lit(0))["norm"].alias("first_norm"), last["text"].alias("last_text"), last["box"]["x1"].alias("last_x1"),
        F.exists(gaps, lambda g: g > COLUMN_GAP * F.col("size")).alias("columns"), F.lit("body").alias("kind"),
    )


def numbered_documents(lines: DataFrame) -> DataFrame:
    """(doc_id, numbered): whether a document has line numbers."""
    return lines.groupBy("doc_id").agg(F.max(F.col("num").isNotNull()).alias("numbered"))


def mark_headers(lines: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Text that recurs at one height near the edge of pages, and page numbers, become header or footer."""
    keyed = lines.withColumn("_at", round_half_up(F.col("base") / BASE_STEP)).withColumn("_key", digit_skeleton("text"))
    seen = keyed.groupBy("doc_id", "_at", "_key").agg(F.count_distinct("page").alias("_pages"))
    sizes = page_sizes.groupBy("doc_id").agg(F.greatest(F.lit(LEAST_PAGES), F.ceil(PAGES_SHARE * F.count("*"))).alias("_least"))
    rows = keyed.join(seen, ["doc_id", "_at", "_key"]).join(sizes, "doc_id").join(page_sizes.select(*PAGE, F.col("height").alias("_height")), list(PAGE))
    top, bottom = F.col("y1") < TOP * F.col("_height"), F.col("y0") > BOTTOM * F.col("_height")
    found = (F.col("_pages") >= F.col("_least")) | (bottom & F.trim("text").rlike(PAGE_NUMBER))
    kind = F.when(F.col("num").isNull() & (top | bottom) & found, F.when(top, "header").otherwise("footer")).otherwise(F.col("kind"))
    return rows.withColumn("kind", kind).select(*lines.columns)


def mark_contents(lines: DataFrame) -> DataFrame:
    """Lines with dot leaders, and on pages with five of them unnumbered lines from a section number to a page number."""
    leader = F.col("text").rlike(LEADER)
    many = F.sum(leader.cast("int")).over(W.partitionBy(*PAGE)) >= 5
    entry = F.col("num").isNull() & F.col("text").rlike(CONTENTS[0]) & F.col("text").rlike(CONTENTS[1])
    return lines.withColumn("_toc", leader | (many & entry)).withColumn("kind", F.when((F.col("kind") == "body") & F.col("_toc"), "toc").otherwise(F.col("kind"))).drop("_toc")


def mark_footnotes(lines: DataFrame, body: DataFrame) -> DataFrame:
    """The run of small unnumbered lines at the end of a page, footers aside, from the first that opens with a mark."""
    small = (F.col("kind") == "body") & F.col("num").isNull() & (F.col("size") <= NOTE_SIZE * F.col("body_size"))
    up = W.partitionBy(*PAGE).orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, 0)
    run = lines.join(body.select("doc_id", "body_size"), "doc_id").withColumn("_run", (F.max(((F.col("kind") != "footer") & ~small).cast("int")).over(up) == 0) & small)
    first = F.min(F.when(F.col("_run") & (F.col("first_norm") == NOTE), F.col("line_no"))).over(W.partitionBy(*PAGE))
    return run.withColumn("_first", first).withColumn("kind", F.when(F.col("_run") & (F.col("line_no") >= F.col("_first")), "footnote").otherwise(F.col("kind"))).select(*lines.columns)


def free(numbered: str = "numbered") -> Column:
    """Whether a line can belong to a float: body, and without a number in documents that number their lines."""
    return (F.col("kind") == "body") & (~F.col(numbered) | F.col("num").isNull())


def caption_lines(lines: DataFrame, body: DataFrame, graphics: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, caption, caption_kind, number): the lines of captions; `caption` is the line it begins at.

    A caption goes on through the free lines that follow closely. Whether a line goes on depends on the one before alone,
    so captions are the islands that begin with a caption's start.
    """
    near = graphics.select(*PAGE, "y0", "y1").unionByName(rules.select(*PAGE, "y0", "y1")).select(*PAGE, F.col("y0").alias("_y0"), F.col("y1").alias("_y1"))
    close = lines.join(near, list(PAGE)).where((F.col("_y0") - NEAR_CAPTION <= F.col("y1")) & (F.col("_y1") + NEAR_CAPTION >= F.col("y0"))).select(*LINE, F.lit(True).alias("_near")).distinct()
    rows = lines.join(body.select("doc_id", "body_size"), "doc_id").join(numbered_documents(lines), "doc_id").join(close, list(LINE), "left")
    kind = caption_kind("norm", F.col("size") < CAPTION_SIZE * F.col("body_size"), F.coalesce("_near", F.lit(False)))
    order = W.partitionBy(*PAGE).orderBy("line_no")
    follows = free() & ~F.col("norm").rlike(CAPTION) & (F.col("base") - F.lag("base").over(order) <= CAPTION_GAP * F.greatest("size", F.lag("size").over(order)))
    marked = rows.withColumn("_start", F.when(free(), kind)).withColumn("_cut", F.when(F.coalesce(follows, F.lit(False)) & F.col("_start").isNull(), F.lit(0)).otherwise(1))
    island = marked.withColumn("_island", F.sum("_cut").over(order.rowsBetween(W.unboundedPreceding, 0)))
    head = W.partitionBy(*PAGE, "_island").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    first = lambda c: F.first(c).over(head)
    named = island.withColumns({"caption": first("line_no"), "caption_kind": first("_start"), "number": first(F.when(F.col("_start").isNotNull(), caption_number("norm")))})
    return named.where("caption_kind is not null").select(*LINE, "caption", "caption_kind", "number")


def caption_boxes(lines: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc_id, page, caption, kind, number, box edges, text, last): one row for each caption."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " ")
    return lines.drop("kind").join(captions, list(LINE)).groupBy(*PAGE, "caption", F.col("caption_kind").alias("kind"), "number").agg(
        *[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in BOX], text.alias("text"), F.max("line_no").alias("last")
    )


def figure_graphics(graphics: DataFrame, boxes: DataFrame) -> DataFrame:
    """Graphics with the caption that each belongs to: the nearest figure caption below, else above; null if none is."""
    figures = boxes.where("kind = 'figure'").select(*PAGE, F.col("caption"), F.col("y0").alias("c_y0"), F.col("y1").alias("c_y1"))
    met = graphics.join(figures, list(PAGE), "left")
    below, above = F.col("c_y0") >= F.col("y1") - GRAPHIC_SLACK, F.col("c_y1") <= F.col("y0") + GRAPHIC_SLACK
    best = W.partitionBy(*PAGE, "graphic").orderBy(F.when(below, 0).when(above, 1).otherwise(2), F.when(below, F.col("c_y0")).otherwise(-F.col("c_y1")), "caption")
    ranked = met.withColumn("_place", F.row_number().over(best)).where("_place = 1")
    return ranked.withColumn("caption", F.when(below | above, F.col("caption"))).select(*graphics.columns, "caption")


def sub_labels(lines: DataFrame, boxes: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, caption): free lines between a figure's graphics and its caption, as far as they overlap."""
    spans = placed.where("caption is not null").groupBy(*PAGE, "caption").agg(F.min("x0").alias("g_x0"), F.max("x1").alias("g_x1"), F.min("y0").alias("g_y0"))
    tops = boxes.select(*PAGE, "caption", F.col("y0").alias("c_y0")).join(spans, [*PAGE, "caption"])
    met = lines.join(numbered_documents(lines), "doc_id").where(free()).join(tops, list(PAGE))
    inside = (F.col("base") > F.col("g_y0")) & (F.col("y0") < F.col("c_y0")) & (F.least("x1", "g_x1") > F.greatest("x0", "g_x0")) & (F.col("y1") <= F.col("c_y0") + 1)
    return met.where(inside).groupBy(*LINE).agg(F.min("caption").alias("caption"))


def settle(lines: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """Lines with `kind` where `found` has them."""
    marked = lines.join(found.select(*LINE, F.lit(kind).alias("_kind")).distinct(), list(LINE), "left")
    return marked.withColumn("kind", F.coalesce("_kind", "kind")).drop("_kind")


def rule_chain(rules: DataFrame, tables: DataFrame, lines: DataFrame, boxes: DataFrame, graphics: DataFrame, body: DataFrame, down: bool) -> DataFrame:
    """(doc_id, page, caption, reach): how far the cluster of rules below (or above) a table's caption goes.

    It starts within reach of the caption and ends at the next caption, or where rules lie far apart with running text, a
    float or a graphic between them.
    """
    sign = 1 if down else -1
    edge = F.col("y1") if down else F.col("y0")
    own = tables.select(*PAGE, "caption", edge.alias("edge"))
    others = boxes.select(*PAGE, F.col("caption").alias("other"), F.col("y0" if down else "y1").alias("other_at"))
    bound = own.join(others, list(PAGE)).where((F.col("other") != F.col("caption")) & (sign * F.col("other_at") > sign * F.col("edge"))).groupBy(*PAGE, "caption").agg((F.min if down else F.max)("other_at").alias("bound"))
    at = F.col("y0") if down else F.col("y1")
    met = rules.join(own.join(bound, [*PAGE, "caption"], "left"), list(PAGE)).where((sign * at >= sign * F.col("edge") - RULE_SLACK) & (F.col("bound").isNull() | (sign * at <= sign * F.col("bound"))))
    middle = met.select(*PAGE, "caption", "edge", ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    chain = W.partitionBy(*PAGE, "caption").orderBy(sign * F.col("y"))
    steps = middle.withColumn("before", F.lag("y").over(chain)).withColumns({"lo": F.least("y", "before"), "hi": F.greatest("y", "before")})
    far = steps.where(F.abs(F.col("y") - F.col("before")) > RULE_GAP).select(*PAGE, "caption", "y", "lo", "hi").distinct()
    row = lines.join(body.select("doc_id", "body_size"), "doc_id").select(*PAGE, "base", (F.col("columns") | (F.col("size") < SCRIPT_ROW * F.col("body_size"))).alias("tabular"))
    between = far.join(row, list(PAGE)).where((F.col("base") > F.col("lo")) & (F.col("base") < F.col("hi"))).groupBy(*PAGE, "caption", "y").agg(F.min("tabular").alias("tabular"))
    blocks = boxes.select(*PAGE, F.col("caption").alias("other"), "y0", "y1").unionByName(graphics.select(*PAGE, F.lit(-1).alias("other"), "y0", "y1")).select(*PAGE, "other", F.col("y0").alias("o_y0"), F.col("y1").alias("o_y1"))
    crossed = far.join(blocks, list(PAGE)).where((F.col("other") != F.col("caption")) & (F.col("o_y0") < F.col("hi")) & (F.col("o_y1") > F.col("lo"))).select(*PAGE, "caption", "y", F.lit(True).alias("crossed")).distinct()
    ended = far.join(between, [*PAGE, "caption", "y"], "left").join(crossed, [*PAGE, "caption", "y"], "left")
    ends = ended.where(~F.coalesce("tabular", F.lit(False)) | F.col("crossed").isNotNull()).select(*PAGE, "caption", "y", F.lit(1).alias("end"))
    ran = steps.join(ends, [*PAGE, "caption", "y"], "left").withColumn("stopped", F.coalesce(F.max("end").over(chain.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    reach = ran.groupBy(*PAGE, "caption", "edge").agg((F.min if down else F.max)("y").alias("first"), (F.max if down else F.min)(F.when(F.col("stopped") == 0, F.col("y"))).alias("reach"))
    return reach.where(F.abs(F.col("first") - F.col("edge")) <= RULE_REACH).select(*PAGE, "caption", "reach")


def table_regions(lines: DataFrame, boxes: DataFrame, graphics: DataFrame, rules: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, page, caption, region_top, region_bottom) of tables with rules: below the caption, else above it."""
    tables = boxes.where("kind = 'table'")
    parts = [rule_chain(rules, tables, lines, boxes, graphics, body, down).withColumnRenamed("reach", name) for down, name in ((True, "below"), (False, "above"))]
    rows = tables.select(*PAGE, "caption", "y0", "y1").join(parts[0], [*PAGE, "caption"], "left").join(parts[1], [*PAGE, "caption"], "left").where("below is not null or above is not null")
    under = F.col("below").isNotNull()
    return rows.select(*PAGE, "caption", F.when(under, F.col("y1")).otherwise(F.col("above") - 1).alias("region_top"), F.when(under, F.col("below") + 1).otherwise(F.col("y0")).alias("region_bottom"))


def table_rows(lines: DataFrame, boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, caption): the rows of tables: free lines of the region, and without rules, in documents with
    line numbers, the lines without one right after the caption."""
    open_ = lines.join(numbered_documents(lines), "doc_id")
    inside = open_.where(free()).join(regions, list(PAGE)).where((F.col("base") > F.col("region_top")) & (F.col("y0") < F.col("region_bottom"))).select(*LINE, "caption")
    bare = boxes.where("kind = 'table'").join(regions, [*PAGE, "caption"], "left_anti").select(*PAGE, "caption", "last")
    after = open_.where("numbered").join(bare, list(PAGE)).where(F.col("line_no") > F.col("last"))
    order = W.partitionBy(*PAGE, "caption").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    run = after.withColumn("_ended", F.max((~free()).cast("int")).over(order)).where("_ended = 0").select(*LINE, "caption")
    return inside.unionByName(run).groupBy(*LINE).agg(F.min("caption").alias("caption"))


def equation_lines(lines: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, equation, number): numbered display equations with the indented lines around them. A line
    between two of them belongs to the one above, if it follows that closely."""
    rows = lines.join(body.select("doc_id", "body_size", "body_left", "body_right"), "doc_id").join(numbered_documents(lines), "doc_id")
    number = F.regexp_extract(normalize_token("last_text"), EQUATION_NUMBER, 1)
    at_edge = (F.col("last_x1") >= F.col("body_right") - EQUATION_EDGE) & (number != "")
    marked = rows.withColumns({"_number": F.when(at_edge, number), "_free": free()}).withColumns({"_head": F.col("_free") & F.col("_number").isNotNull(), "_part": F.col("_free") & F.col("_number").isNull() & (F.col("x0") > F.col("body_left") + EQUATION_INDENT)})
    order = W.partitionBy(*PAGE).orderBy("line_no")
    close = F.coalesce(F.col("base") - F.lag("base").over(order) < EQUATION_GAP * F.col("body_size"), F.lit(False))
    # A line goes on from the one before, or leads to the one after, through display lines and heads alone.
    joined = marked.withColumn("_joins", close & (F.col("_part") | F.col("_head")) & F.coalesce(F.lag(F.col("_part") | F.col("_head")).over(order), F.lit(False)))
    island = joined.withColumn("_island", F.sum((~F.col("_joins")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    group = W.partitionBy(*PAGE, "_island").orderBy("line_no")
    head = F.when(F.col("_head"), F.col("line_no"))
    before, after = F.last(head, ignorenulls=True).over(group.rowsBetween(W.unboundedPreceding, 0)), F.first(head, ignorenulls=True).over(group.rowsBetween(0, W.unboundedFollowing))
    owned = island.withColumn("equation", F.coalesce(before, after)).where("(_head or _part) and equation is not null")
    return owned.select(*LINE, "equation", F.max("_number").over(W.partitionBy(*PAGE, "equation")).alias("number"))


def merged_boxes(orphans: DataFrame) -> DataFrame:
    """(doc_id, page, nth, box edges): graphics without a caption, those close to each other as one, in one pass over a
    page's graphics in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, page, boxes in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "boxes"))):
                made: list[list[float]] = []
                for b in ([g[c] for c in BOX] for g in boxes):
                    near = next((o for o in made if b[0] <= o[2] + MERGE_GAP and b[2] >= o[0] - MERGE_GAP and b[1] <= o[3] + MERGE_GAP and b[3] >= o[1] - MERGE_GAP), None)
                    if near is None:
                        made.append(b)
                    else:
                        near[:] = [min(near[0], b[0]), min(near[1], b[1]), max(near[2], b[2]), max(near[3], b[3])]
                out += [(doc, page, n, *b) for n, b in enumerate(made)]
            kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names=["doc_id", "page", "nth", *BOX])

    rows = orphans.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("graphic", *BOX))).alias("boxes"))
    return rows.mapInArrow(run, "doc_id string, page int, nth int, x0 double, y0 double, x1 double, y1 double")


OBJECTS = ("doc_id", "page", "kind", "number", "caption", *BOX, "key")


def objects_of(lines: DataFrame, body: DataFrame, graphics: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines with their kinds, objects, members): figures, tables and equations with ids in the order of page and top, and
    which lines and graphics belong to each (doc_id, page, object_id, line_no or graphic)."""
    # Each step reads what the ones before made several times over.
    captions = cut(caption_lines(lines, body, graphics, rules))
    boxes = cut(caption_boxes(lines, captions))
    lines = cut(settle(lines, captions, "caption"))
    placed = cut(figure_graphics(graphics, boxes))
    labels = cut(sub_labels(lines, boxes, placed))
    lines = cut(settle(lines, labels, "caption"))
    regions = cut(table_regions(lines, boxes, graphics, rules, body))
    rows = cut(table_rows(lines, boxes, regions))
    lines = cut(settle(lines, rows, "table"))
    equations = cut(equation_lines(lines, body))
    lines = cut(settle(lines, equations, "equation"))
    # What widens each box: its graphics, its rows, and the rules of its region.
    edges = lambda df: df.select(*PAGE, "caption", *BOX)
    ruled = rules.join(regions, list(PAGE)).where((F.col("y0") >= F.col("region_top") - RULE_SLACK) & (F.col("y1") <= F.col("region_bottom") + RULE_SLACK))
    whole = edges(boxes).unionByName(edges(placed.where("caption is not null"))).unionByName(edges(lines.join(rows, list(LINE)))).unionByName(edges(ruled)).groupBy(*PAGE, "caption").agg(*[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in BOX])
    floats = boxes.drop(*BOX).join(whole, [*PAGE, "caption"]).select(*PAGE, "kind", "number", F.col("text").alias("caption"), *BOX, F.concat(F.lit("c"), "caption").alias("key"))
    orphans = merged_boxes(placed.where("caption is null")).select(*PAGE, F.lit("figure").alias("kind"), F.lit("").alias("number"), F.lit("").alias("caption"), *BOX, F.concat(F.lit("g"), "nth").alias("key"))
    in_equation = lines.drop("kind").join(equations, list(LINE))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " ")
    formulas = in_equation.groupBy(*PAGE, "equation", "number").agg(text.alias("caption"), *[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in BOX])
    every = floats.unionByName(orphans).unionByName(formulas.select(*PAGE, F.lit("equation").alias("kind"), "number", "caption", *BOX, F.concat(F.lit("e"), "equation").alias("key")))
    order = W.partitionBy("doc_id").orderBy("page", "y0", "key")
    objects = cut(every.select(*OBJECTS).withColumn("object_id", (F.row_number().over(order) - 1).cast("int")))
    member = lambda df, key, at: df.select(*PAGE, key.alias("key"), at.alias("line_no"))
    c = F.concat(F.lit("c"), "caption")
    joined = member(captions, c, F.col("line_no")).unionByName(member(labels, c, F.col("line_no"))).unionByName(member(rows, c, F.col("line_no"))).unionByName(member(equations, F.concat(F.lit("e"), "equation"), F.col("line_no")))
    members = joined.withColumn("graphic", F.lit(None).cast("int")).unionByName(placed.where("caption is not null").select(*PAGE, c.alias("key"), F.lit(None).cast("int").alias("line_no"), F.col("graphic").cast("int")))
    return lines, objects, members.join(objects.select(*PAGE, "key", "object_id"), [*PAGE, "key"]).drop("key")


def outline_sections(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, title, level): the line of each outline entry: the first on its page, at its height, that
    has the beginning of its title and that no entry before took. A document's entries stream in order."""
    want = F.substring(squash(normalize_token("title")), 1, TITLE_CHARS)
    text = lines.where("kind in ('body', 'heading')").select(*LINE, "base", squash("norm").alias("_said"))
    met = outline.withColumn("_want", want).where("_want <> ''").join(text, list(PAGE)).where(F.contains("_said", "_want") & (F.col("y").isNull() | F.col("base").between(F.col("y") - OUTLINE_ABOVE, F.col("y") + OUTLINE_BELOW)))
    dealt = met.select(*LINE, "entry", "title", "level").repartition("doc_id").sortWithinPartitions("doc_id", "entry", "line_no")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, used, done = None, set(), -1
        for batch in batches:
            kept = []
            for d, page, line, entry in zip(*(batch.column(c).to_pylist() for c in (*LINE, "entry"))):
                if d != doc:
                    doc, used, done = d, set(), -1
                takes = entry != done and (page, line) not in used
                if takes:
                    used.add((page, line))
                    done = entry
                kept.append(takes)
            yield batch.filter(pa.array(kept, pa.bool_())).select([*LINE, "title", "level"])

    return dealt.mapInArrow(run, "doc_id string, page int, line_no int, title string, level int")


def sections_of(lines: DataFrame, body: DataFrame, outline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with kind and section_id, sections): headings from the outline; where no entry was found, numbered lines in
    larger print. A line's section is the last heading at or before it."""
    entries = cut(outline_sections(lines, outline))
    large = lines.join(body.select("doc_id", "body_size"), "doc_id").where((F.col("kind") == "body") & (F.col("size") >= HEADING_SIZE * F.col("body_size")) & F.col("text").rlike(SECTION_START))
    number = F.regexp_extract("text", SECTION_START, 1)
    plain = large.join(entries.select("doc_id").distinct(), "doc_id", "left_anti").select(*LINE, F.regexp_extract("text", SECTION_START, 2).alias("title"), F.size(F.split(number, r"\.")).alias("level"))
    heads = entries.unionByName(plain)
    order = W.partitionBy("doc_id").orderBy("page", "line_no")
    marked = lines.join(heads.withColumn("_head", F.lit(1)), list(LINE), "left")
    counted = marked.withColumn("_n", F.sum("_head").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumns({"section_id": (F.col("_n") - 1).cast("int"), "kind": F.when(F.col("_head") == 1, "heading").otherwise(F.col("kind"))})
    repeats = F.startswith(squash(normalize_token("title")), squash(normalize_token("first_text")))
    shown = F.when(F.col("first_text").rlike(SECTION_NUMBER) & ~repeats, F.regexp_replace("first_text", r"\.$", "")).otherwise("")
    sections = counted.where("_head = 1").select("doc_id", "section_id", shown.alias("number"), "title", "level", "page", F.col("y0").alias("y"), "line_no")
    return counted.drop("title", "level", "_head", "_n"), sections


def structure(lines: DataFrame, page_sizes: DataFrame, body: DataFrame, graphics: DataFrame, rules: DataFrame, outline: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines, objects, members, sections) of documents, in the order in which kinds are settled."""
    marked = cut(mark_footnotes(mark_contents(mark_headers(cut(flat(lines)), page_sizes)), body))
    marked, objects, members = objects_of(marked, body, graphics, rules)
    marked, sections = sections_of(marked, body, outline)
    return marked, objects, members, sections


def probe_captions(items: DataFrame) -> DataFrame:
    """Pages (doc_id, page) on which some text item starts a caption, with its number in the same item or the next two."""
    order = W.partitionBy(*PAGE).orderBy("seq")
    rest = F.when(F.length("str") > 8, F.col("str")).otherwise(F.concat(F.col("str"), F.lit(" "), F.coalesce(F.lead("str", 1).over(order), F.lit("")), F.coalesce(F.lead("str", 2).over(order), F.lit(""))))
    rows = items.withColumn("_rest", rest)
    return rows.where(F.col("str").rlike(r"^(Figure|Fig\.|Table)\b") & F.col("_rest").rlike(r"^(Figure|Fig\.|Table)\s*[A-Z]?[0-9]+(\.[0-9]+)?\s*[:.]")).select(*PAGE).distinct()


def reading_order(parts: DataFrame, by: list[str]) -> DataFrame:
    """Panels (by, box edges) with `place`: rows from top to bottom, a panel of a row if it starts within ten points of the
    one above it in order, then from left to right."""
    down = W.partitionBy(*by).orderBy("y0", "x0")
    row = F.sum(F.coalesce((F.col("y0") - F.lag("y0").over(down) > MERGE_GAP).cast("int"), F.lit(0))).over(down.rowsBetween(W.unboundedPreceding, 0))
    return parts.withColumn("_row", row).withColumn("place", (F.row_number().over(W.partitionBy(*by).orderBy("_row", "x0", "y0")) - 1).cast("int")).drop("_row")
