"""What is shown of a comparison: labels, categories, badges, marks, locations, lists, summaries and annotations.

Changes have (a, b, change_id, kind, cls, …); figures have matches with panels. Everything is column expressions, windows and
joins, so that a list of a million comparisons is one job.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import VERSION_NUMBER, name_version, same_version, version_key

# Which categories are shown unless chosen otherwise, badges, tones and labels.
SHOWN = {"text": True, "numeric": True, "equations": True, "moved": True, "figures": True, "renumber": False, "toc": False}
KIND_NAMES = {"figure": "Figure", "table": "Table", "equation": "Eq."}
FIGURE_BADGES = {"changed": ("Figure changed", "num"), "added": ("Figure added", "ins"), "removed": ("Figure removed", "del"), "pending": ("Comparing…", "ren"), "identical": ("Figure", "ren")}
PANEL_TITLES = {"same": "Panel unchanged", "changed": "Panel changed: click to compare", "new": "New panel", "removed": "Panel not in the new version", "pending": "Comparing…"}
PANEL_RANKS = ("changed", "new", "removed", "pending", "same")
# Tones as red, green and blue, and how strong marks are tinted.
TONES = {"del": (0.86, 0.15, 0.15), "ins": (0.09, 0.64, 0.29), "edit": (0.18, 0.36, 0.84), "num": (0.92, 0.54, 0.0), "mv": (0.49, 0.23, 0.93), "ren": (0.39, 0.45, 0.55), "toc": (0.39, 0.45, 0.55), "fig": (0.92, 0.54, 0.0), "cmt": (0.18, 0.36, 0.84)}
TINTS = {"del": 0.14, "ins": 0.16, "num": 0.24, "ren": 0.12, "toc": 0.12, "mv": 0.07, "edit": 0.16}
# The band of a line that its marks keep to, gaps that end a run, the scale of positions.
BAND_TOP, BAND_BOTTOM, BAND_LEAST, RUN_GAP, PAGE_SCALE = 0.78, 0.25, 0.3, 3, 1e4


def choose(key: Column, values: dict[str, object], otherwise: object = None) -> Column:
    """The value for a key, from a short table of constants."""
    out = F.when(F.lit(False), F.lit(otherwise))
    for k, v in values.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


# ---------------------------------------------------------------------------------------------- changes


def change_label(object_kind: Column, number: Column, line_kind: Column) -> Column:
    """What a change stands in: a caption, a table, an equation, a heading, a footnote or nothing that has a name."""
    in_object = F.when(object_kind == "figure", F.concat(F.lit("Figure "), number, F.lit(" caption"))).when(object_kind == "table", F.concat(F.lit("Table "), number)).when(object_kind == "equation", F.concat(F.lit("Eq. ("), number, F.lit(")")))
    return F.coalesce(in_object, F.when(line_kind == "heading", "Heading").when(line_kind == "footnote", "Footnote"), F.lit(""))


def section_name(number: Column, title: Column) -> Column:
    return F.trim(F.concat(F.coalesce(number, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))))


def class_in_equation(cls: Column, a_kind: Column, b_kind: Column) -> Column:
    """Edits inside display equations have a class of their own; changes of numbers alone keep theirs."""
    inside = F.coalesce(a_kind == "equation", F.lit(False)) | F.coalesce(b_kind == "equation", F.lit(False))
    return F.when((cls == "text") & inside, "equation").otherwise(cls)


def category(kind: Column, cls: Column) -> Column:
    return F.when(cls == "toc", "toc").when(kind == "moved", "moved").otherwise(choose(cls, {"renumber": "renumber", "numeric": "numeric", "equation": "equations"}, "text"))


def entry_category(type_: Column, kind: Column, cls: Column) -> Column:
    return F.when(type_ == "text", category(kind, cls)).when(type_ == "figure", "figures").otherwise("renumber")


def shown(category_: Column, chosen: dict[str, bool] | None = None) -> Column:
    return choose(category_, SHOWN | (chosen or {}), False)


def badge(kind: Column, cls: Column) -> Column:
    """The text of a change's badge."""
    by_kind = choose(kind, {"insert": "Added", "delete": "Removed"}, "Edited")
    by_class = choose(cls, {"numeric": "Number", "renumber": "Renumbered", "toc": "Contents", "equation": "Equation"})
    return F.when(kind == "moved", "Moved").otherwise(F.coalesce(by_class, by_kind))


def mark_class(kind: Column, cls: Column, side: str) -> Column:
    return F.when(kind == "moved", "mv").otherwise(choose(cls, {"numeric": "num", "renumber": "ren", "toc": "toc"}, "del" if side == "a" else "ins"))


def annotation_tone(kind: Column, cls: Column) -> Column:
    by_class = choose(cls, {"numeric": "num", "renumber": "ren", "toc": "ren"})
    return F.when(kind == "moved", "mv").otherwise(F.coalesce(by_class, choose(kind, {"insert": "ins"}, "edit")))


def annotation_text(kind: Column, cls: Column, old: Column, a_page: Column, after: Column) -> Column:
    """What an annotation on a change says."""
    quoted = F.concat(F.lit("“"), old, F.lit("”"))
    place = F.when(after.isNotNull(), F.concat(F.lit(", where it followed “… "), after, F.lit("”"))).otherwise("")
    moved = F.concat(F.lit("Moved here from old page "), (a_page + 1).cast("string"), place, F.lit("."))
    was = choose(cls, {"numeric": "Number changed. Was: ", "renumber": "Renumbered. Was: "}, "Changed. Was: ")
    return F.when(kind == "moved", moved).when(kind == "insert", "Added.").when(kind == "delete", F.concat(F.lit("Removed: "), quoted)).otherwise(F.concat(was, quoted))


def annotation_specs(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """(a, b, change_id, page, type, tone, contents, rects): a caret where nothing new stands, else one annotation a page.

    Changes: (a, b, change_id, kind, cls, old, after, a_page, b_page, b_box); runs: (a, b, change_id, page, nth, box) in b.
    """
    key = ["a", "b", "change_id"]
    c = F.col
    told = changes.select(*key, "b_page", "b_box", annotation_tone(c("kind"), c("cls")).alias("tone"), annotation_text(c("kind"), c("cls"), c("old"), c("a_page"), c("after")).alias("contents"))
    rects = F.transform(F.array_sort(F.collect_list(F.struct("nth", "box"))), lambda r: r["box"])
    by_page = runs.groupBy(*key, "page").agg(rects.alias("rects"))
    rows = told.join(by_page, key, "left")
    caret = F.col("page").isNull()
    return rows.select(
        *key, F.coalesce("page", "b_page").alias("page"), F.when(caret, "Caret").when(F.col("tone") == "mv", "Underline").otherwise("Highlight").alias("type"), F.when(caret, "del").otherwise(F.col("tone")).alias("tone"),
        "contents", F.coalesce("rects", F.array("b_box")).alias("rects"),
    )


def located(words: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, page, box edges, lines) of the words (key, pos, page, line_no, x0, y0, x1, y1): the page of the first one, the box of
    those on it, and the lines of all."""
    first = W.partitionBy(*key).orderBy("pos")
    rows = words.withColumn("_page", F.first("page").over(first))
    here = lambda f, c: f(F.when(F.col("page") == F.col("_page"), F.col(c))).alias(c)
    edges = [here(F.min if c.endswith("0") else F.max, c) for c in ("x0", "y0", "x1", "y1")]
    return rows.groupBy(*key).agg(F.min("_page").alias("page"), *edges, F.array_sort(F.collect_set("line_no")).alias("lines"))


def location_label(least: Column, greatest: Column, page: Column) -> Column:
    """L12, L12–15, or the page where lines have no numbers."""
    span = F.when(least == greatest, F.concat(F.lit("L"), least)).otherwise(F.concat(F.lit("L"), least, F.lit("–"), greatest))
    return F.when(least.isNull(), F.concat(F.lit("p."), page + 1)).otherwise(span)


def line_boxes(words: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, page, line_no, num, box edges) of each line that words stand on."""
    return words.groupBy(*key, "page", "line_no", "num").agg(*[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def change_runs(words: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, page, line_no, run, box edges): words (key, pos, page, line_no, x0, y0, x1, y1) of one line as one run, as long as
    gaps stay below three heights."""
    order = W.partitionBy(*key).orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    starts = ~F.coalesce((before("page") == F.col("page")) & (before("line_no") == F.col("line_no")) & (F.col("x0") - before("x1") < RUN_GAP * (F.col("y1") - F.col("y0"))), F.lit(False))
    runs = words.withColumn("run", (F.sum(starts.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int"))
    return runs.groupBy(*key, "page", "line_no", "run").agg(*[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def in_band(y0: Column, y1: Column, base: Column, size: Column, kind: Column) -> tuple[Column, Column]:
    """A mark's edges clipped to its line's band; marks of scripts alone and of equations keep theirs."""
    top, bottom = F.greatest(y0, base - BAND_TOP * size), F.least(y1, base + BAND_BOTTOM * size)
    whole = (kind == "equation") | (bottom - top < BAND_LEAST * (y1 - y0))
    return F.when(whole, y0).otherwise(top), F.when(whole, y1).otherwise(bottom)


def segments(rows: DataFrame, key: Sequence[str], pos: str, word: str, changed: str, around: int = 4) -> DataFrame:
    """(key, segment, changed, text): changed words with up to `around` words of context, neighbours alike as one run."""
    order = W.partitionBy(*key).orderBy(pos)
    near = F.max(changed).over(order.rowsBetween(-around, around))
    kept = rows.withColumn("_near", near).where("_near")
    starts = F.coalesce((F.lag(pos).over(order) != F.col(pos) - 1) | (F.lag(changed).over(order) != F.col(changed)), F.lit(True))
    runs = kept.withColumn("_starts", starts.cast("int")).withColumn("segment", (F.sum("_starts").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int"))
    words = F.transform(F.array_sort(F.collect_list(F.struct(pos, word))), lambda s: s[word])
    return runs.groupBy(*key, "segment", changed).agg(F.array_join(words, " ").alias("text"))


# ---------------------------------------------------------------------------------------------- lists


def position(page: Column, y: Column) -> Column:
    return page * PAGE_SCALE + y


def entries(text: DataFrame, figures: DataFrame, renumbered: DataFrame) -> DataFrame:
    """(type, id, pos): text changes, figures and renumberings (id, page, y) in one list by place, renumberings just before."""
    one = lambda df, type_, shift: df.select(F.lit(type_).alias("type"), "id", (position(F.col("page"), F.col("y")) - shift).alias("pos"))
    return one(text, "text", 0.0).unionByName(one(figures, "figure", 0.0)).unionByName(one(renumbered, "renumber", 0.1))


def counts_by(rows: DataFrame, *by: str, **conditions: Column) -> DataFrame:
    """How many rows there are of each, and of these how many meet each condition."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def with_headers(rows: DataFrame, group: str, order: Sequence[str], header: Column, item: Column) -> DataFrame:
    """(…, part, line): each row's line, after a header where its group begins."""
    first = F.row_number().over(W.partitionBy(group).orderBy(*order)) == 1
    lines = F.when(first, F.array(header, item)).otherwise(F.array(item))
    return rows.withColumn("_lines", lines).select(group, *order, F.posexplode("_lines").alias("part", "line"))


def comment_visible(unassigned: Column, notes: Column, done: Column, status: Column, show_notes: bool = False, show_done: bool = False, wanted: str | None = None) -> Column:
    """Whether a review list shows a remark: moved counts as changed, general as unresolved."""
    kept = ~unassigned & (F.lit(show_notes) | ~notes) & (F.lit(show_done) | ~done)
    group = choose(status, {"moved": "changed", "general": "unresolved"})
    return kept if wanted is None else kept & (F.coalesce(group, status) == wanted)


def contents(sections_a: DataFrame, sections_b: DataFrame, matches: DataFrame, counted: DataFrame) -> DataFrame:
    """(pair_id, side, section_id, name, n, n_numeric, place): the new sections with their changes, removed ones after the
    closest earlier one that is still there. Sections: (pair_id, section_id, name); matches: (pair_id, a, b); counted: (pair_id,
    name, n, n_numeric)."""
    old = sections_a.join(matches.where("a is not null").select("pair_id", F.col("a").alias("section_id"), "b"), ["pair_id", "section_id"])
    before = W.partitionBy("pair_id").orderBy("section_id").rowsBetween(W.unboundedPreceding, 0)
    gone = old.withColumn("anchor", F.coalesce(F.last("b", ignorenulls=True).over(before), F.lit(-1))).where("b is null").select("pair_id", F.lit("a").alias("side"), "section_id", "name", "anchor")
    new = sections_b.join(matches.where("b is not null").select("pair_id", F.col("b").alias("section_id")), ["pair_id", "section_id"]).select("pair_id", F.lit("b").alias("side"), "section_id", "name", F.col("section_id").alias("anchor"))
    place = W.partitionBy("pair_id").orderBy("anchor", F.desc("side"), "section_id")
    rows = gone.unionByName(new).join(counted, ["pair_id", "name"], "left").fillna(0, ["n", "n_numeric"])
    return rows.select("pair_id", "side", "section_id", "name", "n", "n_numeric", F.row_number().over(place).alias("place"))


def line_links(rows: DataFrame, key: Sequence[str], order: Sequence[str], line: str) -> DataFrame:
    """Of rows in order the first of each run on one line: one link or anchor a line."""
    before = F.lag(line).over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(line))).drop("_before")


def stacked_tops(pages: DataFrame, key: Sequence[str], order: str, height: Column, name: str = "top") -> DataFrame:
    """Where each page begins when a document's pages are stacked."""
    before = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return pages.select(*key, order, F.coalesce(F.sum(height).over(before), F.lit(0)).alias(name))


# ---------------------------------------------------------------------------------------------- figures


def panel_state(status: Column, own: Column, other: Column, same_hash: Column, diff: Column, side: str, threshold: float) -> Column:
    """The state of one panel on one side, from its figure's status, its partner and how much they differ."""
    alone = "removed" if side == "a" else "new"
    compared = F.when(same_hash, "same").when((status == "pending") | diff.isNull(), "pending").when(diff > threshold, "changed").otherwise("same")
    return F.when(status == "added", "new").when(status == "removed", "removed").when(own.isNull(), None).when(other.isNull(), alone).otherwise(compared)


def panel_order(state: Column) -> Column:
    """Changed panels first, then new, removed, pending and the same."""
    return choose(state, {s: i for i, s in enumerate(PANEL_RANKS)}, len(PANEL_RANKS))


def panel_letter(nth: Column) -> Column:
    return F.when(nth < 26, F.concat(F.lit("("), F.char((nth + 97).cast("int")), F.lit(")"))).otherwise(F.concat(F.lit("("), nth + 1, F.lit(")")))


def panel_summaries(panels: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, summary): "(b), (d) changed · (e) new · (c) removed" of panels (key, nth, state)."""
    told = panels.where(F.col("state").isin("changed", "new", "removed")).withColumn("rank", panel_order(F.col("state")))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", panel_letter(F.col("nth")).alias("name")))), lambda s: s["name"]), ", ")
    parts = told.groupBy(*key, "rank", "state").agg(F.concat(named, F.lit(" "), F.first("state")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda s: s["part"]), " · ")
    return parts.groupBy(*key).agg(joined.alias("summary"))


def figure_specs(panels: DataFrame, old_label: str) -> DataFrame:
    """(…, tone, contents) of annotations on panels (status, state, number, nth, panels) that are new or changed."""
    name = F.when(F.coalesce("number", F.lit("")) != "", F.concat(F.lit("Figure "), "number")).otherwise("Figure")
    panel = F.when(F.col("panels") > 1, F.concat(F.lit(" panel "), panel_letter(F.col("nth")))).otherwise("")
    news = F.when(F.col("state") == "new", "new").otherwise("changed")
    said = F.when(F.col("status") == "added", F.concat(F.lit("New "), F.lower(name), F.lit("."))).otherwise(F.concat(name, panel, F.lit(": "), news, F.lit(f" since {old_label}.")))
    return panels.where(F.col("state").isin("new", "changed")).withColumns({"tone": F.when(F.col("state") == "new", "ins").otherwise("fig"), "contents": said})


def renumbering(kind: Column, old: Column, new: Column) -> Column:
    """"Figure 3 → 4", "Eq. (5) → (6)"."""
    shown_ = lambda n: F.when(kind == "equation", F.concat(F.lit("("), n, F.lit(")"))).otherwise(n)
    return F.concat(choose(kind, KIND_NAMES), F.lit(" "), shown_(old), F.lit(" → "), shown_(new))


# ---------------------------------------------------------------------------------------------- sections and scrolling


def match_sections(votes: DataFrame, sections_a: DataFrame, sections_b: DataFrame) -> DataFrame:
    """(pair_id, a, b): each old section with the new one that most of its heading's tokens are in, if that is still free in
    the order of old sections; the others alone. Votes: (pair_id, a, b, n); sections: (pair_id, section_id)."""
    best = W.partitionBy("pair_id", "a").orderBy(F.desc("n"), "b")
    top = votes.withColumn("_place", F.row_number().over(best)).where("_place = 1")
    # Two old sections that want one new section: the earlier has it.
    first = top.withColumn("_turn", F.row_number().over(W.partitionBy("pair_id", "b").orderBy("a"))).where("_turn = 1").select("pair_id", "a", "b")
    left = sections_a.select("pair_id", F.col("section_id").alias("a"))
    right = sections_b.select("pair_id", F.col("section_id").alias("b")).join(first.select("pair_id", "b"), ["pair_id", "b"], "left_anti")
    return left.join(first, ["pair_id", "a"], "left").unionByName(right.select("pair_id", F.lit(None).cast("int").alias("a"), "b"))


# ---------------------------------------------------------------------------------------------- names

SUFFIX = rf"(?i)[-_ ]?v?{VERSION_NUMBER}$"


def resolved_label(name: Column, title: Column) -> tuple[Column, Column]:
    """(the label of a version, the title page's version where it says otherwise): the file name wins."""
    own = name_version(name)
    label = F.coalesce(own, F.regexp_replace(title, r"(?i)\.pdf$", ""))
    differs = own.isNotNull() & title.rlike("^v[0-9]") & ~same_version(version_key(F.substring(title, 2, 100)), version_key(F.substring(own, 2, 100)))
    return label, F.when(differs, title)


def name_stem(name: str | Column) -> Column:
    """A file name without its ending, version and what joins them."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), SUFFIX, ""), r"[-_ ]+$", "")


def common_stems(names: DataFrame, key: Sequence[str], order: str, name: str) -> DataFrame:
    """(key, stem): the stem that most file names share, of equals the first name's or the one seen first."""
    stems = names.select(*key, F.col(order).alias("_at"), name_stem(name).alias("stem")).where("stem <> ''")
    sums = stems.groupBy(*key, "stem").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    best = W.partitionBy(*key).orderBy(F.desc("n"), "first")
    return sums.withColumn("_place", F.row_number().over(best)).where("_place = 1").select(*key, "stem")


def version_places(versions: DataFrame, by: Sequence[str], key: str, order: str) -> DataFrame:
    """Versions with their `place` by the numbers of `key` (an array), missing ones as zero, those without a version last;
    of equals the one loaded first."""
    width = versions.agg(F.max(F.size(key))).first()[0] or 1
    padded = F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda i: F.coalesce(F.get(key, i), F.lit(0)))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.coalesce(F.size(key), F.lit(0)) <= 0, "_key", order))
    return versions.withColumn("_key", padded).withColumn("place", place).drop("_key")


def newest(versions: DataFrame, by: Sequence[str], key: str, order: str, n: int = 2) -> DataFrame:
    """The newest versions, which are compared unless others are chosen."""
    placed = version_places(versions, by, key, order)
    return placed.withColumn("_back", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("place")))).where(F.col("_back") <= n).drop("_back")


# What standard fonts of PDF have no glyph for, and what is written instead.
SUBSTITUTES = {
    "→": "->", "←": "<-", "↔": "<->", "⇒": "=>", "−": "-", "–": "-", "—": "-", "‐": "-", "±": "+/-", "∓": "-/+", "×": "x", "·": ".", "≤": "<=", "≥": ">=", "≈": "~", "≠": "!=", "∝": "~", "∞": "inf",
    "√": "sqrt", "∫": "int", "∑": "sum", "…": "...", "‘": "'", "’": "'", "“": '"', "”": '"', "α": "alpha", "β": "beta", "γ": "gamma", "Γ": "Gamma", "δ": "delta", "Δ": "Delta", "ε": "eps", "ζ": "zeta",
    "η": "eta", "θ": "theta", "κ": "kappa", "λ": "lambda", "Λ": "Lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "Σ": "Sigma", "τ": "tau", "φ": "phi", "Φ": "Phi", "χ": "chi",
    "ψ": "psi", "Ψ": "Psi", "ω": "omega", "Ω": "Omega",
}


def standard_text(text: str) -> str:
    """Text that standard fonts can write: Latin-1, substitutes, base letters, and else question marks."""

    def written(c: str) -> str:
        if c in SUBSTITUTES or c in "\t\n":
            return SUBSTITUTES.get(c, " ")
        if " " <= c <= "~" or "\xa0" <= c <= "\xff":
            return c
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
        return base if base and all(" " <= x <= "~" for x in base) else "?"

    return "".join(map(written, unicodedata.normalize("NFC", text)))


@F.arrow_udf(T.StringType())
def _standard_texts(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else standard_text(t) for t in texts.to_pylist()], pa.string())


def win_ansi(text: str | Column) -> Column:
    return _standard_texts(text)


def formulas(text: str | Column) -> Column:
    """The formulas in a text, with their signs: $$…$$, $…$ that no digit follows, \\(…\\) and \\[…\\]."""
    return F.regexp_extract_all(text, F.lit(r"(\$\$[^$]+\$\$|\$[^$\n]+\$(?![0-9])|\\\(.+?\\\)|\\\[[\s\S]+?\\\])"), 1)
