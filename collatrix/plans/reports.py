"""Registered queries of layout, structure, reporting, stores and resolution, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import layout, reporting, resolve, store, structure
from ..sources.tables import table
from .oracles import ORACLES, VOTES
from .queries import query

c = F.col
CHANGES = """ch AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' WHEN 2 THEN 'replace' ELSE 'moved' END AS kind,
  CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'numeric' WHEN 2 THEN 'renumber' WHEN 3 THEN 'toc' ELSE 'equation' END AS cls FROM documents)"""
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LINES = "li AS (SELECT doc_id, source, CAST(i - 1 AS INT) AS line_no, parts[i] AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) t(i))"


def _changes(spark, sf):
    kind = reporting.choose(c("doc_id") % 4, {0: "insert", 1: "delete", 2: "replace"}, "moved")
    cls = reporting.choose(c("doc_id") % 5, {0: "text", 1: "numeric", 2: "renumber", 3: "toc"}, "equation")
    return table(spark, sf, "documents").select("doc_id", "source", kind.alias("kind"), cls.alias("cls"))


def _lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


# ---------------------------------------------------------------------------------------------- changes


@query
def change_badges(spark, sf):
    kind, cls = c("kind"), c("cls")
    category = reporting.category(kind, cls)
    return _changes(spark, sf).select(
        "doc_id", category.alias("category"), reporting.shown(category).alias("shown"), reporting.badge(kind, cls).alias("badge"), reporting.mark_class(kind, cls, "a").alias("mark_a"), reporting.mark_class(kind, cls, "b").alias("mark_b"),
        reporting.class_in_equation(cls, F.when(c("doc_id") % 3 == 0, "equation"), F.lit(None).cast("string")).alias("cls"),
    )


ORACLES["change_badges"] = f"""WITH {CHANGES}, k AS (SELECT *, CASE WHEN cls = 'toc' THEN 'toc' WHEN kind = 'moved' THEN 'moved' WHEN cls = 'renumber' THEN 'renumber' WHEN cls = 'numeric' THEN 'numeric' WHEN cls = 'equation' THEN 'equations' ELSE 'text' END AS category FROM ch)
    SELECT doc_id, category, category NOT IN ('renumber', 'toc') AS shown,
      CASE WHEN kind = 'moved' THEN 'Moved' WHEN cls = 'numeric' THEN 'Number' WHEN cls = 'renumber' THEN 'Renumbered' WHEN cls = 'toc' THEN 'Contents' WHEN cls = 'equation' THEN 'Equation' WHEN kind = 'insert' THEN 'Added' WHEN kind = 'delete' THEN 'Removed' ELSE 'Edited' END AS badge,
      CASE WHEN kind = 'moved' THEN 'mv' WHEN cls = 'numeric' THEN 'num' WHEN cls = 'renumber' THEN 'ren' WHEN cls = 'toc' THEN 'toc' ELSE 'del' END AS mark_a,
      CASE WHEN kind = 'moved' THEN 'mv' WHEN cls = 'numeric' THEN 'num' WHEN cls = 'renumber' THEN 'ren' WHEN cls = 'toc' THEN 'toc' ELSE 'ins' END AS mark_b,
      CASE WHEN cls = 'text' AND doc_id % 3 = 0 THEN 'equation' ELSE cls END AS cls FROM k"""


@query
def annotation_specs(spark, sf):
    """Documents as changes: those with words in capitals have runs in the new version, others a caret."""
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(1.0).alias("y0"))
    changes = _changes(spark, sf).select(F.lit("a").alias("a"), F.lit("b").alias("b"), c("doc_id").alias("change_id"), "kind", "cls", c("source").alias("old"), F.when(c("doc_id") % 2 == 0, c("source")).alias("after"), (c("doc_id") % 7).alias("a_page"), (c("doc_id") % 9).alias("b_page"), box.alias("b_box"))
    runs = _lines(spark, sf).where("line like 'A%'").select(F.lit("a").alias("a"), F.lit("b").alias("b"), c("doc_id").alias("change_id"), (c("line_no") % 2).cast("long").alias("page"), c("line_no").alias("nth"), box.alias("box"))
    return reporting.annotation_specs(changes, runs).select(c("change_id").alias("doc_id"), "page", "type", "tone", "contents", F.size("rects").alias("n"))


ORACLES["annotation_specs"] = f"""WITH {CHANGES}, {LINES}, t AS (SELECT *, CASE WHEN kind = 'moved' THEN 'mv' WHEN cls = 'numeric' THEN 'num' WHEN cls IN ('renumber', 'toc') THEN 'ren' WHEN kind = 'insert' THEN 'ins' ELSE 'edit' END AS tone,
      CASE WHEN kind = 'moved' THEN 'Moved here from old page ' || (doc_id % 7 + 1) || CASE WHEN doc_id % 2 = 0 THEN ', where it followed “… ' || source || '”' ELSE '' END || '.' WHEN kind = 'insert' THEN 'Added.' WHEN kind = 'delete' THEN 'Removed: “' || source || '”'
        WHEN cls = 'numeric' THEN 'Number changed. Was: “' || source || '”' WHEN cls = 'renumber' THEN 'Renumbered. Was: “' || source || '”' ELSE 'Changed. Was: “' || source || '”' END AS contents FROM ch),
    r AS (SELECT doc_id, CAST(line_no % 2 AS BIGINT) AS page, CAST(count(*) AS INT) AS n FROM li WHERE line LIKE 'A%' GROUP BY 1, 2)
    SELECT t.doc_id, coalesce(r.page, t.doc_id % 9) AS page, CASE WHEN r.page IS NULL THEN 'Caret' WHEN tone = 'mv' THEN 'Underline' ELSE 'Highlight' END AS type, CASE WHEN r.page IS NULL THEN 'del' ELSE tone END AS tone, contents, coalesce(r.n, 1) AS n FROM t LEFT JOIN r USING (doc_id)"""


def _placed_words(spark, sf):
    """Words of turns set in lines of eight, five points a character; those of four characters and more are a change."""
    words = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(X.words("text")).alias("pos", "word"))
    line = F.floor(c("pos") / 8).cast("int")
    x0 = ((c("pos") % 8) * 30).cast("double")
    return words.where(F.length("word") >= 4).select("conv_id", "turn", "pos", F.floor(line / 3).cast("int").alias("page"), line.alias("line_no"), F.when(line % 4 > 0, line).alias("num"), x0.alias("x0"), (line * 12.0).alias("y0"), (x0 + F.length("word") * 5).alias("x1"), (line * 12.0 + 10).alias("y1"))


PLACED = f"""pw AS (SELECT conv_id, turn, CAST(i - 1 AS INT) AS pos, w[i] AS word FROM (SELECT conv_id, turn, {WORDS.format("text")} AS w FROM conversations), unnest(range(1, len(w) + 1)) t(i)),
  wd AS (SELECT conv_id, turn, pos, CAST(pos // 8 // 3 AS INT) AS page, CAST(pos // 8 AS INT) AS line_no, CASE WHEN pos // 8 % 4 > 0 THEN CAST(pos // 8 AS INT) END AS num, (pos % 8) * 30.0::DOUBLE AS x0, pos // 8 * 12.0::DOUBLE AS y0, (pos % 8) * 30.0::DOUBLE + length(word) * 5 AS x1, pos // 8 * 12.0::DOUBLE + 10 AS y1 FROM pw WHERE length(word) >= 4)"""


@query
def change_runs(spark, sf):
    return reporting.change_runs(_placed_words(spark, sf), ["conv_id", "turn"]).drop("page")


ORACLES["change_runs"] = f"""WITH {PLACED}, s AS (SELECT *, CASE WHEN lag(page) OVER o = page AND lag(line_no) OVER o = line_no AND x0 - lag(x1) OVER o < 3 * (y1 - y0) THEN 0 ELSE 1 END AS st FROM wd WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos)),
    r AS (SELECT *, CAST(sum(st) OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS INT) AS run FROM s)
    SELECT conv_id, turn, line_no, run, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r GROUP BY 1, 2, page, 3, 4"""


@query
def located_changes(spark, sf):
    found = reporting.located(_placed_words(spark, sf), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "page", "x0", "y0", "x1", "y1", F.size("lines").alias("n_lines"))


ORACLES["located_changes"] = f"""WITH {PLACED}, f AS (SELECT *, first_value(page) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS p FROM wd)
    SELECT conv_id, turn, min(p) AS page, min(x0) FILTER (page = p) AS x0, min(y0) FILTER (page = p) AS y0, max(x1) FILTER (page = p) AS x1, max(y1) FILTER (page = p) AS y1, CAST(count(DISTINCT line_no) AS INT) AS n_lines FROM f GROUP BY 1, 2"""


@query
def location_labels(spark, sf):
    lines = reporting.line_boxes(_placed_words(spark, sf), ["conv_id", "turn"])
    rows = lines.groupBy("conv_id", "turn").agg(F.min("num").alias("lo"), F.max("num").alias("hi"), F.min("page").alias("page"))
    return rows.select("conv_id", "turn", reporting.location_label(c("lo"), c("hi"), c("page")).alias("label"))


ORACLES["location_labels"] = f"WITH {PLACED} SELECT conv_id, turn, CASE WHEN min(num) IS NULL THEN 'p.' || (min(page) + 1) WHEN min(num) = max(num) THEN 'L' || min(num) ELSE 'L' || min(num) || '–' || max(num) END AS label FROM wd GROUP BY 1, 2"


@query
def line_links(spark, sf):
    return reporting.line_links(_placed_words(spark, sf), ["conv_id", "turn"], ["pos"], "line_no").select("conv_id", "turn", "pos", "line_no")


ORACLES["line_links"] = f"WITH {PLACED} SELECT conv_id, turn, pos, line_no FROM wd QUALIFY lag(line_no) OVER (PARTITION BY conv_id, turn ORDER BY pos) IS DISTINCT FROM line_no"


@query
def line_bands(spark, sf):
    """Boxes of vectors clipped to the band of a line at their middle."""
    at = lambda i: c("embedding")[i].cast("double")
    rows = table(spark, sf, "embeddings").select("vec_id", F.least(at(1), at(3)).alias("y0"), F.greatest(at(1), at(3)).alias("y1"), at(5).alias("base"), F.abs(at(6)).alias("size"), F.when(c("label") == 0, "equation").otherwise("body").alias("kind"))
    top, bottom = reporting.in_band(c("y0"), c("y1"), c("base"), c("size"), c("kind"))
    return rows.select("vec_id", F.round(top, 9).alias("top"), F.round(bottom, 9).alias("bottom"))


ORACLES["line_bands"] = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), b AS (SELECT vec_id, label, least(e[2], e[4]) AS y0, greatest(e[2], e[4]) AS y1, e[6] AS base, abs(e[7]) AS size FROM e),
    t AS (SELECT *, greatest(y0, base - 0.78::DOUBLE * size) AS top, least(y1, base + 0.25::DOUBLE * size) AS bottom FROM b), k AS (SELECT *, label = 0 OR bottom - top < 0.3::DOUBLE * (y1 - y0) AS whole FROM t)
    SELECT vec_id, round(CASE WHEN whole THEN y0 ELSE top END, 9) AS top, round(CASE WHEN whole THEN y1 ELSE bottom END, 9) AS bottom FROM k"""


# ---------------------------------------------------------------------------------------------- figures and lists


def _panels(spark, sf):
    state = reporting.choose(c("vec_id") % 6, {0: "changed", 1: "same", 2: "new", 3: "removed", 4: "pending"}, "changed")
    return table(spark, sf, "embeddings").select(F.floor(c("vec_id") / 4).alias("match_id"), "vec_id", (c("vec_id") % 4).alias("nth"), state.alias("state"), F.when(c("label") > 0, c("label").cast("string")).otherwise("").alias("number"), F.when(c("vec_id") % 16 < 4, "added").otherwise("changed").alias("status"))


PANELS = "pn AS (SELECT vec_id // 4 AS match_id, vec_id, vec_id % 4 AS nth, CASE vec_id % 6 WHEN 0 THEN 'changed' WHEN 1 THEN 'same' WHEN 2 THEN 'new' WHEN 3 THEN 'removed' WHEN 4 THEN 'pending' ELSE 'changed' END AS state, CASE WHEN label > 0 THEN CAST(label AS VARCHAR) ELSE '' END AS number, CASE WHEN vec_id % 16 < 4 THEN 'added' ELSE 'changed' END AS status FROM embeddings)"
RANK = "CASE state WHEN 'changed' THEN 0 WHEN 'new' THEN 1 WHEN 'removed' THEN 2 WHEN 'pending' THEN 3 ELSE 4 END"


@query
def panel_summaries(spark, sf):
    return reporting.panel_summaries(_panels(spark, sf), ["match_id"])


ORACLES["panel_summaries"] = f"""WITH {PANELS}, g AS (SELECT match_id, {RANK} AS r, string_agg('(' || chr(CAST(97 + nth AS INT)) || ')', ', ' ORDER BY nth) || ' ' || state AS part FROM pn WHERE state IN ('changed', 'new', 'removed') GROUP BY match_id, state)
    SELECT match_id, string_agg(part, ' · ' ORDER BY r) AS summary FROM g GROUP BY 1"""


@query
def figure_specs(spark, sf):
    return reporting.figure_specs(_panels(spark, sf).withColumn("panels", F.lit(4)), "v1").select("vec_id", "tone", "contents")


ORACLES["figure_specs"] = f"""WITH {PANELS}, n AS (SELECT *, CASE WHEN number <> '' THEN 'Figure ' || number ELSE 'Figure' END AS name FROM pn WHERE state IN ('new', 'changed'))
    SELECT vec_id, CASE state WHEN 'new' THEN 'ins' ELSE 'fig' END AS tone, CASE WHEN status = 'added' THEN 'New ' || lower(name) || '.' ELSE name || ' panel (' || chr(CAST(97 + nth AS INT)) || '): ' || state || ' since v1.' END AS contents FROM n"""


@query
def panel_order(spark, sf):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("match_id").orderBy(reporting.panel_order(c("state")), "nth"))
    return _panels(spark, sf).select("match_id", "vec_id", place.alias("place"))


ORACLES["panel_order"] = f"WITH {PANELS} SELECT match_id, vec_id, CAST(row_number() OVER (PARTITION BY match_id ORDER BY {RANK}, nth) AS INT) AS place FROM pn"


@query
def renumberings(spark, sf):
    kind = reporting.choose(c("p_size") % 3, {0: "figure", 1: "table"}, "equation")
    rows = table(spark, sf, "part").select("p_partkey", kind.alias("kind"), c("p_size").cast("string").alias("old"), (c("p_size") + 1).cast("string").alias("new"))
    return rows.select("p_partkey", reporting.renumbering(c("kind"), c("old"), c("new")).alias("label"), reporting.change_label(c("kind"), c("old"), F.lit("body")).alias("place"))


ORACLES["renumberings"] = """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Figure ' || p_size || ' → ' || (p_size + 1) WHEN 1 THEN 'Table ' || p_size || ' → ' || (p_size + 1) ELSE 'Eq. (' || p_size || ') → (' || (p_size + 1) || ')' END AS label,
    CASE p_size % 3 WHEN 0 THEN 'Figure ' || p_size || ' caption' WHEN 1 THEN 'Table ' || p_size ELSE 'Eq. (' || p_size || ')' END AS place FROM part"""


@query
def visible_comments(spark, sf):
    status = reporting.choose(c("o_orderkey") % 6, {0: "removed", 1: "changed", 2: "moved", 3: "unchanged", 4: "unresolved"}, "general")
    flag = lambda n: c("o_custkey") % n == 0
    rows = table(spark, sf, "orders").select("o_orderkey", status.alias("status"), flag(7).alias("unassigned"), flag(5).alias("notes"), flag(3).alias("done"))
    kept = reporting.comment_visible(c("unassigned"), c("notes"), c("done"), c("status"), show_done=True, wanted="changed")
    return rows.where(kept).select("o_orderkey", "status")


ORACLES["visible_comments"] = "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'changed' ELSE 'moved' END AS status FROM orders WHERE o_custkey % 7 <> 0 AND o_custkey % 5 <> 0 AND o_orderkey % 6 IN (1, 2)"


@query
def contents_counts(spark, sf):
    """Nations as sections of regions: every third is removed, the others keep their place; customers are the changes."""
    nations = table(spark, sf, "nation").select(c("n_regionkey").alias("pair_id"), c("n_nationkey").alias("section_id"), c("n_name").alias("name"))
    matches = nations.select("pair_id", c("section_id").alias("a"), F.when(c("section_id") % 3 > 0, c("section_id")).alias("b"))
    met = table(spark, sf, "customer").join(table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey"))
    counted = reporting.counts_by(met.withColumnsRenamed({"n_regionkey": "pair_id", "n_name": "name"}), "pair_id", "name", n_numeric=c("c_acctbal") < 0)
    return reporting.contents(nations, nations, matches, counted)


ORACLES["contents_counts"] = """WITH k AS (SELECT n_regionkey AS pair_id, n_name AS name, count(*) AS n, CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS n_numeric FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    a AS (SELECT n_regionkey AS pair_id, n_nationkey AS section_id, n_name AS name, last_value(CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey END IGNORE NULLS) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM nation),
    u AS (SELECT pair_id, 'a' AS side, section_id, name, coalesce(anchor, -1) AS anchor FROM a WHERE section_id % 3 = 0 UNION ALL SELECT n_regionkey, 'b', n_nationkey, n_name, n_nationkey FROM nation WHERE n_nationkey % 3 > 0)
    SELECT pair_id, side, section_id, name, coalesce(n, 0) AS n, coalesce(n_numeric, 0) AS n_numeric, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY anchor, side DESC, section_id) AS INT) AS place FROM u LEFT JOIN k USING (pair_id, name)"""


@query
def section_matches(spark, sf):
    """Customers' nations vote for the nations of suppliers with an equal rest: one new section for an old one."""
    votes = table(spark, sf, "customer").groupBy(F.lit(0).alias("pair_id"), c("c_nationkey").alias("a"), (c("c_custkey") % 12).cast("int").alias("b")).agg(F.count("*").alias("n"))
    nations = table(spark, sf, "nation").select(F.lit(0).alias("pair_id"), c("n_nationkey").alias("section_id"))
    return reporting.match_sections(votes, nations, nations).select("a", "b")


ORACLES["section_matches"] = """WITH v AS (SELECT c_nationkey AS a, CAST(c_custkey % 12 AS INT) AS b, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT a, b FROM v QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
    f AS (SELECT a, b FROM t QUALIFY row_number() OVER (PARTITION BY b ORDER BY a) = 1)
    SELECT n_nationkey AS a, b FROM nation LEFT JOIN f ON a = n_nationkey UNION ALL SELECT NULL, n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT b FROM f)"""


# ---------------------------------------------------------------------------------------------- names and texts


@query
def workspace_stems(spark, sf):
    host = F.regexp_extract("url", "//([^/]+)", 1)
    name = F.concat(F.regexp_extract("url", "//[^/]+/([^/?#]*)", 1), F.lit("-v"), c("page_id").cast("string"), F.lit(".pdf"))
    return reporting.common_stems(table(spark, sf, "pages").select(host.alias("host"), "page_id", name.alias("name")), ["host"], "page_id", "name")


ORACLES["workspace_stems"] = r"""WITH n AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS host, page_id, regexp_extract(url, '//[^/]+/([^/?#]*)', 1) || '-v' || page_id AS name FROM pages),
    s AS (SELECT host, page_id, regexp_replace(regexp_replace(name, '(?i)[-_ ]?v?[0-9]+(?:[._r][0-9]+)*$', ''), '[-_ ]+$', '') AS stem FROM n), g AS (SELECT host, stem, count(*) AS k, min(page_id) AS f FROM s WHERE stem <> '' GROUP BY 1, 2)
    SELECT host, stem FROM g QUALIFY row_number() OVER (PARTITION BY host ORDER BY k DESC, f) = 1"""


@query
def resolved_labels(spark, sf):
    name = F.when(c("page_id") % 3 > 0, F.concat(F.lit("note_v"), c("page_id") % 5, F.lit("_0.pdf"))).otherwise("note.pdf")
    title = F.when(c("page_id") % 2 == 0, F.concat(F.lit("v"), c("page_id") % 4)).otherwise("draft.pdf")
    label, other = reporting.resolved_label(name, title)
    return table(spark, sf, "pages").select("page_id", label.alias("label"), other.alias("title_label"))


ORACLES["resolved_labels"] = """SELECT page_id, CASE WHEN page_id % 3 > 0 THEN 'v' || (page_id % 5) || '.0' WHEN page_id % 2 = 0 THEN 'v' || (page_id % 4) ELSE 'draft' END AS label,
    CASE WHEN page_id % 3 > 0 AND page_id % 2 = 0 AND page_id % 4 <> page_id % 5 THEN 'v' || (page_id % 4) END AS title_label FROM pages"""


@query
def standard_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", reporting.win_ansi(F.concat("text", F.lit(" α→β"))).alias("text"))


ORACLES["standard_texts"] = "SELECT doc_id, translate(replace(replace(replace(replace(replace(replace(replace(text, '…', '...'), '‘', ''''), '’', ''''), '“', '\"'), '”', '\"'), '–', '-'), '—', '-'), chr(10) || chr(9), '  ') || ' alpha->beta' AS text FROM documents"


@query
def formulas(spark, sf):
    text = F.concat(F.lit("so $a$ and \\(b_"), c("p_size"), F.lit("\\) or $$c"), c("p_partkey"), F.lit("$$ for \\[d\\]"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(reporting.formulas(text), "|").alias("found"))


ORACLES["formulas"] = r"SELECT p_partkey, '$a$|\(b_' || p_size || '\)|$$c' || p_partkey || '$$|\[d\]' AS found FROM part"


# ---------------------------------------------------------------------------------------------- stores


@query
def restored_versions(spark, sf):
    """Orders as workspaces, their parts as versions; files are the parts of even size."""
    versions = table(spark, sf, "lineitem").select(c("l_orderkey").alias("workspace_id"), c("l_partkey").alias("hash")).distinct()
    files = table(spark, sf, "part").where("p_size % 2 = 0").select(c("p_partkey").alias("hash"))
    return store.restored(versions, files).select("workspace_id", "hash", "found")


ORACLES["restored_versions"] = "SELECT DISTINCT l_orderkey AS workspace_id, l_partkey AS hash, l_partkey IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0) AS found FROM lineitem"


@query
def listed_workspaces(spark, sf):
    spaces = table(spark, sf, "orders").select(c("o_orderkey").alias("workspace_id"), c("o_orderdate").alias("updated"))
    versions = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("workspace_id"))
    return store.listed(spaces, versions).select("workspace_id", "n_versions")


ORACLES["listed_workspaces"] = "SELECT l_orderkey AS workspace_id, count(*) AS n_versions FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1"


@query
def figure_results(spark, sf):
    """Pairs of neighbouring vectors without a kept result (an even id), under the names that results are kept by."""
    pairs = table(spark, sf, "embeddings").select("vec_id", c("vec_id").cast("string").alias("a"), (c("vec_id") + 1).cast("string").alias("b")).withColumn("key", store.figure_key(3, "a", "b"))
    return store.missing(pairs, pairs.where("vec_id % 2 = 0"), ["key"]).select("key")


ORACLES["figure_results"] = "SELECT 'fig3:' || vec_id || ':' || (vec_id + 1) AS key FROM embeddings WHERE vec_id % 2 <> 0"


@query
def absent_files(spark, sf):
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("hash"))
    stored = table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("hash"))
    return store.put_absent(docs, stored, "hash")


ORACLES["absent_files"] = "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)"


# ---------------------------------------------------------------------------------------------- structure


def _source_lines(spark, sf):
    """Documents as pages of their source, sixty points a line, with a running title and page numbers."""
    base = c("line_no") * 60.0 + 40
    text = F.when(c("line_no") == 0, F.concat(F.lit("Draft "), "doc_id")).when(c("line_no") % 12 == 11, c("line_no").cast("string")).otherwise(c("line"))
    rows = _lines(spark, sf).where("line <> ''").withColumn("line", text).select(
        c("source").alias("doc_id"), c("doc_id").cast("int").alias("page"), "line_no", F.when(c("line_no") % 5 == 4, c("line_no")).alias("num"), base.alias("base"), F.when(c("line_no") % 3 == 0, 9.0).otherwise(10.0).alias("size"),
        F.lit(0.0).alias("x0"), (base - 8).alias("y0"), F.lit(100.0).alias("x1"), (base + 2).alias("y1"), c("line").alias("text"), F.when(F.length("line") % 2 == 0, layout.NOTE).otherwise("x").alias("first_norm"), F.lit("body").alias("kind"),
    )
    sizes = table(spark, sf, "documents").select(c("source").alias("doc_id"), c("doc_id").cast("int").alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return rows, sizes


SOURCE_LINES = f"""{LINES}, sl AS (SELECT source AS doc_id, CAST(doc_id AS INT) AS page, line_no, CASE WHEN line_no % 5 = 4 THEN line_no END AS num, line_no * 60.0::DOUBLE + 40 AS base, CASE WHEN line_no % 3 = 0 THEN 9.0::DOUBLE ELSE 10.0::DOUBLE END AS size, t AS text, CASE WHEN length(t) % 2 = 0 THEN '#fn' ELSE 'x' END AS first_norm FROM (SELECT *, CASE WHEN line_no = 0 THEN 'Draft ' || doc_id WHEN line_no % 12 = 11 THEN CAST(line_no AS VARCHAR) ELSE line END AS t FROM li WHERE line <> ''))"""


@query
def page_edges(spark, sf):
    lines, sizes = _source_lines(spark, sf)
    return structure.mark_headers(lines, sizes).where("kind <> 'body'").select("doc_id", "page", "line_no", "kind")


ORACLES["page_edges"] = rf"""WITH {SOURCE_LINES}, k AS (SELECT *, floor(base / 3 + 0.5) AS spot, regexp_replace(text, '[0-9.]+', '#', 'g') AS key FROM sl), n AS (SELECT doc_id, spot, key, count(DISTINCT page) AS pages FROM k GROUP BY 1, 2, 3),
    z AS (SELECT source AS doc_id, greatest(3, ceil(0.3::DOUBLE * count(*))) AS least FROM documents GROUP BY 1)
    SELECT doc_id, page, line_no, CASE WHEN base + 2 < 96 THEN 'header' ELSE 'footer' END AS kind FROM k JOIN n USING (doc_id, spot, key) JOIN z USING (doc_id)
    WHERE num IS NULL AND (base + 2 < 96 OR base - 8 > 680) AND (pages >= least OR (base - 8 > 680 AND regexp_matches(trim(text, ' '), '(?i)^([ivxlc]+|[0-9]+)$')))"""


@query
def contents_lines(spark, sf):
    """Lines whose every fourth word stands for a dot leader."""
    lines, _ = _source_lines(spark, sf)
    dotted = F.when(F.length("text") % 4 == 0, F.concat("text", F.lit(" . . . . . . 7"))).when(F.length("text") % 4 == 1, F.lit("A.2 Extra 12")).otherwise(c("text"))
    return structure.mark_contents(lines.withColumn("text", dotted)).where("kind = 'toc'").select("doc_id", "page", "line_no")


ORACLES["contents_lines"] = rf"""WITH {SOURCE_LINES}, d AS (SELECT *, CASE length(text) % 4 WHEN 0 THEN text || ' . . . . . . 7' WHEN 1 THEN 'A.2 Extra 12' ELSE text END AS t FROM sl),
    m AS (SELECT *, regexp_matches(t, '(\.\s?){{5,}}') AS leader FROM d), n AS (SELECT *, sum(CASE WHEN leader THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page) AS leaders FROM m)
    SELECT doc_id, page, line_no FROM n WHERE leader OR (leaders >= 5 AND num IS NULL AND regexp_matches(t, '\s[0-9]+$') AND regexp_matches(t, '^([A-Z]|[0-9]+)(\.[0-9]+)*\s'))"""


@query
def footnote_lines(spark, sf):
    lines, _ = _source_lines(spark, sf)
    body = lines.select("doc_id").distinct().withColumn("body_size", F.lit(10.0))
    return structure.mark_footnotes(lines, body).where("kind = 'footnote'").select("doc_id", "page", "line_no")


ORACLES["footnote_lines"] = f"""WITH {SOURCE_LINES}, k AS (SELECT *, num IS NULL AND size <= 9.2::DOUBLE AS small FROM sl), r AS (SELECT *, max(CASE WHEN small THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) = 0 AS run FROM k),
    f AS (SELECT *, min(CASE WHEN run AND first_norm = '#fn' THEN line_no END) OVER (PARTITION BY doc_id, page) AS first FROM r) SELECT doc_id, page, line_no FROM f WHERE run AND line_no >= first"""


@query
def body_modes(spark, sf):
    """The most frequent line length of a language to tens; of equals the one that was so frequent first."""
    lines = _lines(spark, sf).where("line <> ''").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return layout.mode_of(lines, ["lang"], ["doc_id", "line_no"], F.length("line"), 10, "size").select("lang", c("size").cast("int").alias("size"))


ORACLES["body_modes"] = f"""WITH {LINES}, r AS (SELECT d.lang, l.doc_id, l.line_no, CAST(floor(length(l.line) / 10 + 0.5) * 10 AS INT) AS size FROM li l JOIN documents d USING (doc_id) WHERE l.line <> ''),
    n AS (SELECT *, row_number() OVER (PARTITION BY lang, size ORDER BY doc_id, line_no) AS nth FROM r) SELECT lang, size FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY nth DESC, doc_id, line_no) = 1"""


@query
def reading_orders(spark, sf):
    at = lambda i: F.round(c("embedding")[i].cast("double") * 100, 6)
    parts = table(spark, sf, "embeddings").select("vec_id", F.floor(c("vec_id") / 8).alias("figure"), at(0).alias("x0"), at(1).alias("y0"))
    return structure.reading_order(parts, ["figure"]).select("vec_id", "place")


ORACLES["reading_orders"] = """WITH p AS (SELECT vec_id, vec_id // 8 AS figure, round(CAST(embedding[1] AS DOUBLE) * 100, 6) AS x0, round(CAST(embedding[2] AS DOUBLE) * 100, 6) AS y0 FROM embeddings),
    s AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY figure ORDER BY y0, x0) > 10 THEN 1 ELSE 0 END AS st FROM p), r AS (SELECT *, sum(st) OVER (PARTITION BY figure ORDER BY y0, x0) AS row_ FROM s)
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY figure ORDER BY row_, x0, y0) - 1 AS INT) AS place FROM r"""


# ---------------------------------------------------------------------------------------------- resolution


@query
def mapped_references(spark, sf):
    """Orders as references, their items as tokens: returned ones stay, others changed or moved."""
    item = (c("l_orderkey") * 10 + c("l_linenumber")).alias("tok")
    rows = table(spark, sf, "lineitem")
    # An item that occurs again keeps its first row in the table, as DISTINCT ON does, however the files are dealt to tasks.
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    first = rows.groupBy(item).agg(F.min_by(F.struct("l_partkey", "l_returnflag", "l_linestatus"), place).alias("row")).select("tok", "row.*")
    tokens = first.select("tok", F.when(c("l_returnflag") != "N", c("l_partkey")).alias("other"), reporting.choose(c("l_returnflag"), {"A": "same", "R": "moved"}, "changed").alias("state"), F.when(c("l_linestatus") == "O", c("l_partkey")).alias("change_id"))
    kind = F.when(c("p_size") % 3 == 0, "insert").when(c("p_size") % 3 == 1, "moved").otherwise("replace")
    changes = table(spark, sf, "part").select(c("p_partkey").alias("change_id"), kind.alias("kind"), F.when(c("p_size") % 4 == 0, "renumber").otherwise("text").alias("cls"), (c("p_partkey") * 40 + 2).alias("a_at"), F.when(c("p_size") % 3 == 0, 0).otherwise(1).alias("n_old"), (c("p_size") % 2).alias("n_new"))
    anchors = rows.select(c("l_orderkey").alias("ref_id"), item).distinct()
    return resolve.map_tokens(anchors, tokens, changes).select("ref_id", "status")


ORACLES["mapped_references"] = """WITH t AS (SELECT DISTINCT ON (l_orderkey * 10 + l_linenumber) l_orderkey AS ref_id, l_orderkey * 10 + l_linenumber AS tok, CASE WHEN l_returnflag <> 'N' THEN l_partkey END AS other, CASE l_returnflag WHEN 'A' THEN 'same' WHEN 'R' THEN 'moved' ELSE 'changed' END AS state, CASE WHEN l_linestatus = 'O' THEN l_partkey END AS change_id FROM lineitem),
    k AS (SELECT p_partkey AS change_id, CASE p_size % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'moved' ELSE 'replace' END AS kind, CASE WHEN p_size % 4 = 0 THEN 'renumber' ELSE 'text' END AS cls, p_partkey * 40 + 2 AS a_at, p_size % 3 > 0 AS old, p_size % 2 AS n_new FROM part),
    x AS (SELECT t.*, kind, coalesce(cls = 'renumber', false) AS silent FROM t LEFT JOIN k USING (change_id)), sp AS (SELECT ref_id, min(tok) AS lo, max(tok) AS hi FROM t GROUP BY 1),
    u AS (SELECT ref_id, change_id FROM x WHERE change_id IS NOT NULL AND kind IS NOT NULL UNION SELECT ref_id, change_id FROM sp JOIN k ON NOT old AND a_at > lo AND a_at <= hi),
    ch AS (SELECT ref_id, bool_or(cls <> 'renumber' AND kind <> 'moved') AS real, sum(n_new) AS n_new FROM u JOIN k USING (change_id) GROUP BY 1),
    tk AS (SELECT ref_id, bool_and(state = 'same' OR silent) AS same, bool_or(state = 'moved' AND NOT silent) AS moved, count(other) AS mapped FROM x GROUP BY 1)
    SELECT ref_id, CASE WHEN NOT coalesce(real, false) AND same THEN 'unchanged' WHEN NOT coalesce(real, false) AND moved THEN 'moved' WHEN mapped = 0 AND coalesce(n_new, 0) = 0 THEN 'removed' ELSE 'changed' END AS status FROM tk LEFT JOIN ch USING (ref_id)"""


@query
def entry_lines(spark, sf):
    """Lines that begin with an A as heads of entries, those of four characters and fewer as ends."""
    found = resolve.entry_lines(_lines(spark, sf), "doc_id", "line_no", c("line").rlike("^A"), F.length("line") <= 4)
    return found.select("doc_id", "line_no", "entry")


ORACLES["entry_lines"] = f"""WITH {LINES}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS nth, count(*) OVER (PARTITION BY doc_id) AS al, line LIKE 'A%' AS head FROM li),
    g AS (SELECT *, sum(CASE WHEN head OR length(line) <= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM p),
    r AS (SELECT *, first_value(head AND nth * 3 > al) OVER w AS inside, row_number() OVER w AS turn, first_value(line_no) OVER w AS entry FROM g WINDOW w AS (PARTITION BY doc_id, run ORDER BY line_no))
    SELECT doc_id, line_no, entry FROM r WHERE inside AND turn <= 8"""


@query
def phrase_hits(spark, sf):
    """The first three words of each turn of even number within the turn before the last word."""
    words = table(spark, sf, "conversations").where("turn = 0").select("conv_id", X.words("text").alias("w"))
    snippets = words.select(c("conv_id").alias("snippet_id"), F.slice("w", 1, 3).alias("words"))
    tokens = words.select(F.posexplode("w").alias("at", "word"), "conv_id").select((c("conv_id") * 100000 + c("at")).alias("tok"), "word")
    return resolve.phrase_hits(snippets, tokens).select("snippet_id", "tok")


ORACLES["phrase_hits"] = f"""WITH w AS (SELECT conv_id, {WORDS.format("text")} AS w FROM conversations WHERE turn = 0), t AS (SELECT conv_id * 100000 + i - 1 AS tok, w[i] AS a, CASE WHEN len(w) > i THEN w[i + 1] END AS b, CASE WHEN len(w) > i + 1 THEN w[i + 2] END AS d FROM w, unnest(range(1, len(w) + 1)) u(i))
    SELECT w.conv_id AS snippet_id, tok FROM w JOIN t ON a = w.w[1] AND (len(w.w) < 2 OR b = w.w[2]) AND (len(w.w) < 3 OR d = w.w[3])"""


@query
def closest_hits(spark, sf):
    """For each user the click nearest in value to one half."""
    clicks = table(spark, sf, "events").where("event_type = 'click'").select("user_id", "event_id", "value")
    return resolve.closest(clicks, ["user_id"], F.abs(c("value") - 0.5), ["event_id"]).select("user_id", "event_id")


ORACLES["closest_hits"] = "SELECT user_id, event_id FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 0.5::DOUBLE), event_id) = 1"


@query
def changed_sections(spark, sf):
    """Short lines as headings of level one or two, lines with a digit as changed."""
    level = (F.length("line") % 2 + 1).alias("level")
    heads = _lines(spark, sf).where("length(line) between 1 and 30").select("doc_id", c("line_no").alias("section_id"), level, c("line_no").alias("line"))
    return resolve.section_changed(heads, _lines(spark, sf).where(c("line").rlike("[0-9]")).select("doc_id", c("line_no").alias("line")))


ORACLES["changed_sections"] = f"""WITH {LINES}, h AS (SELECT doc_id, line_no, length(line) % 2 + 1 AS level FROM li WHERE length(line) BETWEEN 1 AND 30), d AS (SELECT doc_id, line_no AS hit FROM li WHERE regexp_matches(line, '[0-9]')),
    e AS (SELECT h.doc_id, h.line_no, min(n.line_no) AS fin FROM h LEFT JOIN h n ON n.doc_id = h.doc_id AND n.line_no > h.line_no AND n.level <= h.level GROUP BY 1, 2)
    SELECT e.doc_id, line_no AS section_id, coalesce(bool_or(hit >= line_no AND (fin IS NULL OR hit < fin)), false) AS changed FROM e LEFT JOIN d USING (doc_id) GROUP BY 1, 2"""


@query
def comment_history(spark, sf):
    refs = table(spark, sf, "labels").select((c("doc_id") % 10).alias("review_id"), "doc_id", (c("doc_id") % 4).cast("int").alias("place"))
    versions = spark.range(10).select(c("id").alias("review_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place")).withColumn("version", F.concat(F.lit("v"), "place"))
    return resolve.history(refs, versions).select("doc_id", c("later").alias("version"))


ORACLES["comment_history"] = "SELECT doc_id, 'v' || p AS version FROM labels, range(0, 4) t(p) WHERE p > doc_id % 4"


# ---------------------------------------------------------------------------------------------- SQL of earlier queries

ORACLES["token_forms"] = f"""WITH w AS (SELECT unnest({WORDS.format("text")}) AS word FROM documents)
    SELECT word, count(*) AS n, '"' || nfc_normalize(word) || '''...' AS norm FROM w GROUP BY 1"""
ORACLES["review_references"] = """SELECT 'line' AS kind, count(*) AS n, CAST(sum(doc_id % 900 + 1) AS BIGINT) AS first, CAST(0 AS BIGINT) AS n_ids, CAST(0 AS BIGINT) AS items FROM documents
    UNION ALL SELECT 'figure', count(*), 0, count(*), 0 FROM documents UNION ALL SELECT 'table', count(*), 0, 2 * count(*), count(*) FROM documents UNION ALL SELECT 'equation', count(*), 0, count(*), 2 * count(*) FROM documents"""
ORACLES["page_pairs"] = f"""WITH {VOTES}, sz AS (SELECT doc_id, CAST(max(pos) // 40 + 1 AS INT) AS n FROM uq GROUP BY 1), pr AS (SELECT DISTINCT a, b FROM best),
    pg AS (SELECT pr.a, pr.b, x.n AS an, y.n AS bn FROM pr JOIN sz x ON x.doc_id = pr.a JOIN sz y ON y.doc_id = pr.b),
    nw AS (SELECT pg.a, pg.b, CAST(p AS INT) AS b_page, s.a_page AS want FROM pg, unnest(range(0, bn)) t(p) LEFT JOIN best s ON s.a = pg.a AND s.b = pg.b AND s.b_page = p),
    n2 AS (SELECT a, b, b_page, CASE WHEN want IS NOT NULL AND row_number() OVER (PARTITION BY a, b, want ORDER BY b_page) = 1 THEN want END AS a_page FROM nw),
    od AS (SELECT pg.a, pg.b, CAST(p AS INT) AS a_page FROM pg, unnest(range(0, an)) t(p) WHERE NOT EXISTS (SELECT 1 FROM n2 WHERE n2.a = pg.a AND n2.b = pg.b AND n2.a_page = p)),
    pl AS (SELECT od.a, od.b, od.a_page, coalesce(max(n2.b_page), -1) + 0.5 AS place FROM od LEFT JOIN n2 ON n2.a = od.a AND n2.b = od.b AND n2.a_page < od.a_page GROUP BY 1, 2, 3),
    al AS (SELECT a, b, a_page, b_page, CAST(b_page AS DOUBLE) AS place FROM n2 UNION ALL SELECT a, b, a_page, NULL, place FROM pl)
    SELECT a, b, CAST(row_number() OVER (PARTITION BY a, b ORDER BY place, a_page NULLS FIRST) - 1 AS INT) AS seq, a_page, b_page FROM al"""
