"""The registered queries of the version-comparison operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import alignment, layout, matching, objects, raster, reporting, resolve, review, shingles, store, windows
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
PAGE_TOKENS = 40
LEAST_SHARED = 20


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    return shingles.near_copies(table(spark, sf, "documents").select("doc_id", "text"), LEAST_SHARED)


@query
def doc_lines(spark, sf):
    return _lines(table(spark, sf, "documents")).select("doc_id", "line_no", "line")


@query
def doc_tokens(spark, sf):
    tokens = table(spark, sf, "documents").select("doc_id", F.posexplode(X.words("text")).alias("tok", "word"))
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.max("tok").alias("last_tok"), F.sum(F.length("word")).alias("n_chars"), F.countDistinct("word").alias("n_distinct"))


@query
def token_forms(spark, sf):
    """Words in typographic quotes, with an ellipsis, in their normal form, and how often they occur. Each distinct word is
    normalised once."""
    words = table(spark, sf, "documents").select(F.explode(X.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.withColumn("norm", X.normalize_token(F.concat(F.lit("\u201c"), "word", F.lit("\u2019\u2026"))))


@query
def digit_skeleton(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.digit_skeleton("url").alias("skeleton"))


@query
def suspicious_glyphs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").alias("glyphs"), X.suspicious_glyphs("text").alias("suspicious"))


@query
def repeated_lines(spark, sf):
    """Lines that recur in documents of a source as running headers do on pages: in three, and in a hundredth of them."""
    docs = table(spark, sf, "documents")
    sizes = docs.groupBy("source").agg(F.count("*").alias("pages"))
    seen = _lines(docs).where("line <> ''").groupBy("source", X.digit_skeleton("line").alias("skeleton")).agg(F.countDistinct("doc_id").alias("n_docs"))
    least = F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.01))
    return seen.join(sizes, "source").where(F.col("n_docs") >= least).select("source", "skeleton", "n_docs")


@query
def unique_shingles(spark, sf):
    found = shingles.unique_shingles(table(spark, sf, "documents").select("doc_id", "text"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_unique"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query
def text_classes(spark, sf):
    return shingles.text_classes(table(spark, sf, "documents").select("doc_id", "text"))


@query
def near_copy_pairs(spark, sf):
    return _copies(spark, sf).drop("label")


def _copies_and_tokens(spark, sf):
    return _copies(spark, sf), alignment.tokens_of(table(spark, sf, "documents"))


@query
def edit_ops(spark, sf):
    return alignment.scripts(*_copies_and_tokens(spark, sf))


@query
def edit_cover(spark, sf):
    """What edit scripts must add up to: the tokens of both sides."""
    n = alignment.script_totals(*_copies_and_tokens(spark, sf))
    return n.select("a", "b", (F.col("equal") + F.col("deleted")).alias("a_tokens"), (F.col("equal") + F.col("inserted")).alias("b_tokens"))


@query
def pair_changes(spark, sf):
    return alignment.pair_changes(*_copies_and_tokens(spark, sf))


@query
def pair_change_summary(spark, sf):
    return pair_changes(spark, sf).groupBy("kind", "cls").agg(F.count("*").alias("n"))


@query
def op_islands(spark, sf):
    runs = windows.islands(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role")
    return runs.groupBy("conv_id", "island", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query
def bridge_groups(spark, sf):
    edit = F.col("event_type").isin("error", "purchase")
    groups = windows.bridged_groups(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], edit, F.lit(1))
    return groups.groupBy("user_id", F.col("group").alias("grp")).agg(F.count("*").alias("n_edits"), F.min("event_id").alias("least_event"), F.max("event_id").alias("greatest_event"))


@query
def consecutive_share(spark, sf):
    line = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = table(spark, sf, "lineitem").select("l_returnflag", (F.lag("l_linenumber").over(line) + 1 == F.col("l_linenumber")).alias("follows"))
    return steps.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("follows").cast("int"), F.lit(0))).cast("long").alias("n_follow"))


@query
def line_number_column(spark, sf):
    """The column of numbers (a bucket of places), for each return flag, with most steps of one; at least 15 numbers, six
    tenths of the steps so."""
    bucket = F.floor(F.col("l_quantity") / 25).cast("int")
    rows = table(spark, sf, "lineitem").select("l_returnflag", bucket.alias("bucket"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("place"))
    dense = F.row_number().over(W.partitionBy("l_returnflag", "bucket").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    # Numbers that rise by one but for every seventh, and in odd buckets for every second.
    num = F.when((F.col("nth") % 7 == 0) | ((F.col("nth") % 2 == 0) & (F.col("bucket") % 2 == 1)), -F.col("nth")).otherwise(F.col("nth"))
    numbered = rows.withColumn("nth", dense).withColumn("num", num)
    return layout.steady_columns(numbered, ["l_returnflag"], ["bucket"], ["nth"])


PAIRS = [
    ("1", "(12", "(15", "=", "", "", False, False),
    ("2", "12", "14", "Fig.", "", "", False, False),
    ("3", "13", "15", "and", "12", "Figs.", False, False),
    ("4", "[13-15].", "[16-18].", "in", "", "", False, True),
    ("5", "[13-15].", "[16-18].", "in", "", "", False, False),
    ("6", "[37.4,", "[37.9,", "", "", "", False, True),
    ("7", "alpha", "beta", "", "", "", False, False),
    ("8", "x", "x", "", "", "", False, False),
    ("9", "3.2", "3.3", "Section", "", "", False, False),
    ("10", "4", "5", "", "", "", True, False),
    ("11", "(A.3)", "(A.4)", "in", "", "", False, False),
    ("12", "[23]", "[24]", "see", "", "", False, False),
    ("13", "8", "9", "7,", "Tables", "", False, False),
    ("14", "1.23", "1.31", "of", "", "", False, False),
    ("15", "12a", "34b", "was", "", "", False, False),
    ("16", "12", "twelve", "Fig.", "", "", False, False),
]
PAIR_COLUMNS = "id string, old string, new string, p1 string, p2 string, p3 string, heading boolean, cited boolean"


@query
def classify_pairs(spark, sf):
    rows = spark.createDataFrame(PAIRS, PAIR_COLUMNS)
    c = F.col
    return rows.select("id", X.classify_pair(c("old"), c("new"), c("p1"), c("p2"), c("p3"), c("heading"), c("cited")).alias("cls"))


@query
def bag_dice(spark, sf):
    lower = lambda c: X.words(F.lower(c))
    items = matching.bags(table(spark, sf, "benchmark"), ["item_id"], lower("text"))
    turns = matching.bags(table(spark, sf, "conversations"), ["conv_id", "turn"], lower("text"))
    return matching.dice(items, turns, ["item_id"], ["conv_id", "turn"], 0.15).select("item_id", "conv_id", "turn", "common", F.round("score", 9).alias("score"))


@query
def caption_candidates(spark, sf):
    bag = matching.bags(table(spark, sf, "benchmark"), ["item_id"], X.words(F.lower("text")))
    scored = matching.dice(bag.withColumnRenamed("item_id", "a"), bag.withColumnRenamed("item_id", "b"), ["a"], ["b"], 0.2).where("a < b")
    return scored.select("a", "b", F.round(F.col("score") - 0.001 * F.abs(F.col("a") - F.col("b")), 9).alias("score"))


@query
def greedy_match(spark, sf):
    lower = lambda c: X.words(F.lower(c))
    items = matching.bags(table(spark, sf, "benchmark"), ["item_id"], lower("text"))
    turns = matching.bags(table(spark, sf, "conversations"), ["conv_id", "turn"], lower("text"))
    return matching.greedy_pairs(matching.dice(items, turns, ["item_id"], ["conv_id", "turn"], 0.15), "conv_id", "item_id", "turn", "score", 0.15)


def _page_votes(spark, sf):
    return shingles.page_votes(table(spark, sf, "documents").select("doc_id", "text"), PAGE_TOKENS, LEAST_SHARED)


def _best_pages(spark, sf):
    return matching.best_votes(_page_votes(spark, sf), ["a", "b", "b_page"], "a_page", "n")


@query
def page_votes(spark, sf):
    """The old page that each new page has most in common with: for pairs of different texts, and for each other copy of a
    text with the first."""
    copies = shingles.copy_votes(table(spark, sf, "documents").select("doc_id", "text"), PAGE_TOKENS, LEAST_SHARED)
    return _best_pages(spark, sf).unionByName(copies)


@query
def unpaired_pages(spark, sf):
    """Old pages between the first and last that a new page chose, and that none chose."""
    best = _best_pages(spark, sf)
    span = best.groupBy("a", "b").agg(F.min("a_page").alias("lo"), F.max("a_page").alias("hi"))
    every = span.select("a", "b", F.explode(F.sequence("lo", "hi")).alias("a_page"))
    return every.join(best.select("a", "b", "a_page"), ["a", "b", "a_page"], "left_anti")


@query
def asof_place(spark, sf):
    events = table(spark, sf, "events")
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    placed = events.withColumn("click_id", windows.last_before(events, ["user_id"], ["ts", "event_id"], click))
    return placed.where("event_type = 'purchase'").select("event_id", "user_id", "click_id")


@query
def interpolate_pos(spark, sf):
    """The value that a view would have between the clicks around it."""
    events = table(spark, sf, "events").withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    y = F.when(F.col("event_type") == "click", F.col("value"))
    placed = events.withColumn("at", windows.interpolate(["user_id"], ["ts", "event_id"], F.col("x"), y))
    return placed.where("event_type = 'view'").select("event_id", F.round("at", 4).alias("at"))


@query
def forward_fill_section(spark, sf):
    """Lines with the heading they stand under: the last short line at or before them."""
    heading = F.when(F.length("line").between(1, 30), F.col("line_no"))
    filled = _lines(table(spark, sf, "documents")).withColumn("section", windows.fill_forward(["doc_id"], ["line_no"], heading))
    return filled.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


def _quotes(spark, sf):
    return matching.quoted_in(table(spark, sf, "benchmark"), table(spark, sf, "documents").select("doc_id", "text"), X.words("text"), X.words("text"))


@query
def snippet_hits(spark, sf):
    return _quotes(spark, sf)


@query
def round_evidence(spark, sf):
    """For each item the source that holds most of its quotes, if one has more than every other."""
    by_source = _quotes(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("item_id", "source").agg(F.count("*").alias("n"))
    place = W.partitionBy("item_id").orderBy(F.desc("n"), "source")
    top = by_source.withColumn("place", F.row_number().over(place)).where("place <= 2")
    both = top.groupBy("item_id").agg(F.max(F.when(F.col("place") == 1, F.col("n"))).alias("best"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("n"))), F.lit(0)).alias("second"), F.max(F.when(F.col("place") == 1, F.col("source"))).alias("source"))
    return both.select("item_id", "best", "second", F.when(F.col("best") > F.col("second"), F.col("source")).alias("source"))


REVIEW = [
    (1, 'L12: "teh" should read "the"'),
    (2, "- L595-L597: say how the bound is applied"),
    (3, "Figure 2: add a legend, as in Fig 24"),
    (4, "Table 9 and 10: keep both in Section 3"),
    (5, "Eq. 12: define f"),
    (6, "Sec 4.1 and Section 5.2.4 and App F"),
    (7, "Ref 29: add the link; also refs 11"),
    (8, "Make the figure 2 columns wide"),
]


@query
def ref_patterns(spark, sf):
    """The numbers that lines of a review cite, by kind."""
    found = review.references_in(spark.createDataFrame(REVIEW, "line int, text string"))
    return found.select("line", "kind", F.explode("ids").alias("ref"))


STATUSES = ["removed", "changed", "moved", "unchanged", "unresolved"]


def _statuses(spark, sf):
    status = F.when(F.col("toxic") == 1, "removed").when(F.col("quality") == 0, "changed").when(F.col("doc_id") % 3 == 0, "moved").when(F.col("doc_id") % 3 == 1, "unchanged").otherwise("unresolved")
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return table(spark, sf, "labels").withColumn("status", status).join(docs, "doc_id")


@query
def ref_status_rank(spark, sf):
    return matching.worst_status(_statuses(spark, sf), ["source", "lang"], "status", STATUSES)


@query
def lead_status(spark, sf):
    """The first status that is resolved, else the first."""
    return resolve.lead_status(_statuses(spark, sf), ["source"], "doc_id")


@query
def segments_context(spark, sf):
    """Capitalised words of a turn with four words around them: runs of changed and context words."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(X.words("text")).alias("pos", "word"))
    return reporting.segments(rows.withColumn("changed", F.col("word").rlike("^[A-Z]")), ["conv_id", "turn"], "pos", "word", "changed")


def _boxes(spark, sf, *keep):
    at = lambda i: F.col("embedding")[i].cast("double")
    box = G.ordered_box(at(0), at(1), at(2), at(3))
    return table(spark, sf, "embeddings").select("vec_id", "label", *[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))], *keep)


def _box(prefix=""):
    return tuple(F.col(f"{prefix}{n}") for n in ("x0", "y0", "x1", "y1"))


@query
def box_union(spark, sf):
    return _boxes(spark, sf).groupBy("label").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


@query
def box_iou(spark, sf):
    """Graphics of one page (label) and neighbouring order whose boxes overlap by half."""
    boxes = _boxes(spark, sf).withColumn("page", F.floor(F.col("vec_id") / 25))
    b = boxes.select("page", F.col("vec_id").alias("b"), F.col("label").alias("b_label"), *[F.col(n).alias(f"b_{n}") for n in ("x0", "y0", "x1", "y1")])
    met = boxes.withColumnRenamed("vec_id", "a").join(b, "page").where((F.col("a") < F.col("b")) & (F.col("label") == F.col("b_label")))
    score = G.iou(_box(), _box("b_"))
    return met.select("a", "b", F.round(score, 9).alias("iou")).where("iou > 0.2")


@query
def point_in_box(spark, sf):
    """For each point (components 4 and 5) the smallest box of its page that contains it."""
    rows = _boxes(spark, sf, F.col("embedding")[4].cast("double").alias("px"), F.col("embedding")[5].cast("double").alias("py")).withColumn("page", F.floor(F.col("vec_id") / 25))
    boxes = rows.select("page", F.col("vec_id").alias("box_id"), "x0", "y0", "x1", "y1")
    met = rows.select("page", F.col("vec_id").alias("point_id"), "px", "py").join(boxes, "page").where(G.contains(_box(), F.col("px"), F.col("py")))
    return met.groupBy("point_id").agg(F.min_by("box_id", F.struct(G.area(_box()).alias("area"), "box_id")).alias("box_id"))


NAMES = [("note_v3.pdf",), ("note-v3_5.pdf",), ("PAPER-v4r1.pdf",), ("draft.pdf",), ("V2.0.pdf",), ("review12.pdf",)]


@query
def version_labels(spark, sf):
    names = spark.createDataFrame(NAMES, "name string").unionByName(table(spark, sf, "pages").select(F.concat(F.lit("v"), F.regexp_extract("url", "/([0-9]+)(?:[?#]|$)", 1), F.lit("_0")).alias("name")).distinct())
    label = X.name_version("name")
    key = X.trim_zeros(X.version_key(F.substring(label, 2, 100)))
    return names.select("name", label.alias("label"), F.array_join(key.cast("array<string>"), ".").alias("version"))


@query
def version_order(spark, sf):
    """Pages by the version in their path: its numbers, missing ones as zero, those without one last."""
    found = F.regexp_extract("url", "/([0-9]+(?:-[0-9]+)*)(?:[?#]|$)", 1)
    key = F.transform(F.filter(F.split(found, "-"), lambda p: p != ""), lambda p: p.cast("int"))
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), key.alias("key"))
    return reporting.version_places(pages, ["host"], "key", "page_id").select("page_id", "host", F.array_join(F.col("key").cast("array<string>"), ".").alias("version"), "place")


@query
def newest_versions(spark, sf):
    """The two newest versions of each host."""
    found = F.regexp_extract("url", "/([0-9]+)(?:[?#]|$)", 1)
    key = F.transform(F.filter(F.array(found), lambda p: p != ""), lambda p: p.cast("int"))
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), key.alias("key"))
    return reporting.newest(pages, ["host"], "key", "page_id").select("page_id", "host")


@query
def retention(spark, sf):
    """The thirty newest entries stay."""
    return store.newest_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", store.KEPT_VERSIONS)


@query
def cache_miss(spark, sf):
    return store.missing(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query
def entries_union(spark, sf):
    """Text changes, figures and renumberings in one list by place."""
    at = lambda name, where, id_, page, y: table(spark, sf, name).where(where).select(F.col(id_).alias("id"), F.col(page).cast("double").alias("page"), y.alias("y"))
    text = at("orders", "o_orderstatus = 'F'", "o_orderkey", "o_custkey", F.col("o_totalprice") % 1000)
    figures, renumbered = at("part", "p_size > 40", "p_partkey", "p_size", F.lit(0.0)), at("supplier", "true", "s_suppkey", "s_nationkey", F.lit(0.0))
    return reporting.entries(text, figures, renumbered).select("type", "id", F.round("pos", 3).alias("pos"))


@query
def category_counts(spark, sf):
    return reporting.counts_by(_statuses(spark, sf), "status")


@query
def section_counts(spark, sf):
    return reporting.counts_by(table(spark, sf, "documents"), "source", "lang", n_numeric=F.col("text").rlike("[0-9]"))


def _panel_pairs(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("raster"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other_label"), F.col("raster").alias("other"))
    return rows.join(other, "vec_id", "left")


@query
def ink_ratio(spark, sf):
    ratio = G.ink_ratio(F.col("raster"), F.col("other"), 0.1, 0.2, 5.0)
    return _panel_pairs(spark, sf).where("other is not null").select("vec_id", F.round(ratio, 9).alias("ratio"))


@query
def panel_states(spark, sf):
    """Vectors as panels of the old version against the next one: equal labels as equal graphics, else their ink tells."""
    ratio = G.ink_ratio(F.col("raster"), F.col("other"), 0.1, 0.2, 5.0)
    c = F.col
    state = reporting.panel_state(F.lit("changed"), c("vec_id"), c("other_label"), c("label") == c("other_label"), F.when(c("other").isNotNull(), ratio), "a", 0.5)
    return _panel_pairs(spark, sf).select("vec_id", state.alias("state"))


@query
def html_text_lines(spark, sf):
    text = F.regexp_replace(F.regexp_replace("html", "(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", ""), "<[^>]*>", "\n")
    lines = table(spark, sf, "pages").select("page_id", F.explode(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("line"))
    return lines.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query
def caption_starts(spark, sf):
    rows = [(1, "Figure 3: The fit", False, False), (2, "Fig. 4. One two three four", True, False), (3, "Fig. 4. One two three four", False, False), (4, "Table A.1: Yields", False, False), (5, "Figure 3 shows", True, True), (6, "Table 2. too short", True, True)]
    lines = spark.createDataFrame(rows, "id int, line string, small boolean, near boolean")
    kind = X.caption_kind("line", F.col("small"), F.col("near"))
    return lines.select("id", kind.alias("kind"), F.when(kind.isNotNull(), X.caption_number("line")).alias("number"))


@query
def body_geometry(spark, sf):
    """The most frequent line length by language, rounded to tens; the shortest of equals."""
    counts = _lines(table(spark, sf, "documents")).where("line <> ''").groupBy("lang", (X.round_half_up(F.length("line") / 10) * 10).cast("int").alias("size")).agg(F.count("*").alias("n"))
    return matching.best_votes(counts, ["lang"], "size", "n")


@query
def page_heights(spark, sf):
    """Where each conversation turn begins when turns are stacked by their length."""
    return reporting.stacked_tops(table(spark, sf, "conversations"), ["conv_id"], "turn", F.length("text"))


@query
def equal_share(spark, sf):
    """Tokens that the versions of a pair have in common at equal places of their scripts, over all tokens."""
    n = alignment.script_totals(*_copies_and_tokens(spark, sf))
    both = 2 * F.col("equal") + F.col("deleted") + F.col("inserted")
    return n.select("a", "b", F.round(2 * F.col("equal") / both, 9).alias("share"))


@query
def panel_pairs(spark, sf):
    """Panels of pages of ten vectors: the even ones of one version, the odd ones of the other, labels as fingerprints."""
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("key"), F.col("vec_id").alias("part"), F.when(F.col("label") > 0, F.col("label").cast("string")).otherwise("").alias("hash"))
    return objects.pair_panels(rows.where("part % 2 = 0"), rows.where("part % 2 = 1"))


@query
def page_pairs(spark, sf):
    return shingles.page_pairs(table(spark, sf, "documents").select("doc_id", "text"), PAGE_TOKENS, LEAST_SHARED)


def _float_objects(spark, sf, side):
    """Vectors as floats, twenty to a pair of versions: even ones of the old, odd ones of the new, benchmark passages as
    captions, labels as numbers, every third with its label as fingerprint."""
    rows = _boxes(spark, sf).where(F.col("vec_id") % 2 == side)
    captions = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("caption"))
    number = F.when(F.col("label") > 0, F.col("label").cast("string")).otherwise("")
    placed = rows.withColumn("item", F.floor(F.col("vec_id") / 2) % 40).join(captions, "item", "left")
    return placed.select(
        F.floor(F.col("vec_id") / 20).alias("pair_id"), F.col("vec_id").cast("int").alias("id"), F.when(F.col("label") % 2 == 0, "figure").otherwise("table").alias("kind"), number.alias("number"), "caption",
        (F.col("vec_id") % 5).cast("int").alias("page"), F.lit(8).alias("pages"), F.struct("x0", "y0", "x1", "y1").alias("box"), F.when(F.col("vec_id") % 6 < 2, F.array(F.col("label").cast("string"))).otherwise(F.array().cast("array<string>")).alias("hashes"),
    )


@query
def object_pairs(spark, sf):
    """Pairs by every tier: aligned text for every fourth float, equal graphics, captions, numbers, places."""
    a, b = _float_objects(spark, sf, 0), _float_objects(spark, sf, 1)
    votes = a.where("id % 8 = 0").select("pair_id", F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.9).alias("score"))
    return objects.pair_objects(a, b, votes)


@query
def raster_scores(spark, sf):
    """Vectors as 8 x 8 panels, grey by size, against the next vector's."""
    grey = lambda c: F.transform(c, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), (255 - F.abs(x) * 600).cast("int"))))
    pixels = lambda c: F.unhex(F.array_join(F.transform(grey(c), lambda g: F.concat(*[F.lpad(F.hex(g), 2, "0")] * 3, F.lit("FF"))), ""))
    side = F.lit(8)
    rows = _panel_pairs(spark, sf).where("other is not null").select(
        F.col("vec_id").cast("string").alias("key"), pixels("raster").alias("a_rgba"), side.alias("a_width"), side.alias("a_height"), pixels("other").alias("b_rgba"), side.alias("b_width"), side.alias("b_height")
    )
    return raster.compare_panels(rows)


@query
def review_references(spark, sf):
    """References in reviews made of documents: a round with an item that cites lines, a figure and two tables, and a
    remark that quotes."""
    n = F.col("doc_id").cast("string")
    lines = F.array(F.lit("## Round 1 comments"), F.lit(""), F.concat(F.lit("- L"), F.col("doc_id") % 900 + 1, F.lit("-"), F.col("doc_id") % 900 + 3, F.lit(": see Fig. "), n), F.concat(F.lit("- Tables "), n, F.lit(" and "), F.col("doc_id") + 1, F.lit(": keep both")), F.concat(F.lit("- Eq. ("), n, F.lit("): define it")))
    reviews = table(spark, sf, "documents").select(n.alias("review_id"), F.array_join(lines, "\n").alias("text"))
    found = review.remark_references(reviews)
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("first").alias("first"), F.sum(F.size("ids")).alias("n_ids"), F.sum("item").alias("items"))


@query
def unused_files(spark, sf):
    """Files (parts) that none of the fifteen newest workspaces (orders) has."""
    newest = store.newest_rows(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "o_orderdate", "l_orderkey", store.KEPT_WORKSPACES)
    versions = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return store.unused(table(spark, sf, "part").select("p_partkey"), versions, newest, "l_orderkey", "p_partkey")


@query
def summary_lines(spark, sf):
    """A list of labelled documents by source with a line for each new source before its items."""
    item = F.concat_ws(" ", F.lit("-"), F.col("doc_id").cast("string"), F.col("status"))
    return reporting.with_headers(_statuses(spark, sf), "source", ["doc_id"], F.concat(F.lit("## "), F.col("source")), item)


@query
def version_files(spark, sf):
    """Names that are safe for files, clipped, with the hash that they are kept under."""
    return table(spark, sf, "pages").select("page_id", X.clip(X.safe_name("url"), 30).alias("name"), F.sha2(F.col("url").cast("binary"), 256).alias("version_id"))


def queries() -> dict[str, Query]:
    return dict(FOUND)
