import pytest
from pyspark.sql import functions as F

from collatrix.operators import structure as S
from collatrix.operators.layout import LINES

RULES = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"
GRAPHICS = "doc_id string, page int, graphic int, x0 double, y0 double, x1 double, y1 double, hash string"
OUTLINE = "doc_id string, page int, entry int, title string, level int, y double"


def line(page, base, text, size=10.0, x=72.0, num=None, words=None):
    """A line at `base`; words of five points a character unless they are given as (text, x)."""
    placed, at = [], x
    for w in words or text.split():
        t, at = w if isinstance(w, tuple) else (w, at)
        placed.append((t, "#fn" if t == "*1" else t, (float(at), base - 0.75 * size, at + 5.0 * len(t), base + 0.25 * size), t == "*1"))
        at += 5 * len(t) + 4
    box = (placed[0][2][0], base - 0.75 * size, max(p[2][2] for p in placed), base + 0.25 * size)
    return ["d", page, 0, num, float(base), float(size), box, " ".join(p[0] for p in placed), placed]


def documents(spark, rows, pages=1, rules=(), graphics=(), outline=()):
    for page in {r[1] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[1] == page), key=lambda r: r[4])):
            r[2] = n
    lines = spark.createDataFrame([tuple(r) for r in rows], LINES)
    sizes = spark.createDataFrame([("d", p, 600.0, 800.0) for p in range(pages)], "doc_id string, page int, width double, height double")
    body = spark.createDataFrame([("d", 10.0, 72.0, 500.0)], "doc_id string, body_size double, body_left double, body_right double")
    made = S.structure(lines, sizes, body, spark.createDataFrame(list(graphics), GRAPHICS), spark.createDataFrame(list(rules), RULES), spark.createDataFrame(list(outline), OUTLINE))
    kinds = {(r.page, r.text): r.kind for r in made[0].collect()}
    objects = {r.object_id: r for r in made[1].collect()}
    return kinds, objects, made[2].collect(), made[3].orderBy("section_id").collect(), made[0]


def test_page_edges_contents_and_footnotes(spark):
    rows = []
    for p in range(4):
        rows += [line(p, 40, f"Draft of day {p}"), line(p, 300, f"Words of page {p}"), line(p, 780, f"{p + 1}")]
    rows += [line(0, 50, "Only here"), line(0, 50, "numbered", num=4), line(1, 700, "see *1 above", 8), line(1, 712, "", 8, words=["*1", "a", "note"]), line(1, 724, "goes on", 8)]
    rows += [line(2, 100 + 12 * k, f"{k} Title . . . . . . {k}") for k in range(1, 6)] + [line(2, 200, "A.1 Plain 12"), line(2, 212, "Plain 12")]
    kinds, _, _, _, _ = documents(spark, rows, 4)
    assert [kinds[p, f"Draft of day {p}"] for p in range(4)] == ["header"] * 4 and kinds[2, "3"] == "footer"
    assert kinds[0, "Only here"] == kinds[0, "numbered"] == "body"
    assert kinds[1, "see *1 above"] == "body" and kinds[1, "*1 a note"] == kinds[1, "goes on"] == "footnote"
    assert kinds[2, "3 Title . . . . . . 3"] == kinds[2, "A.1 Plain 12"] == "toc" and kinds[2, "Plain 12"] == "body"


def test_figures_take_graphics_labels_and_captions(spark):
    rows = [line(0, 310, "Figure 3: Two panels that", 9), line(0, 322, "share an axis", 9), line(0, 400, "Running text goes on"), line(0, 290, "(a) left", 8, 150.0), line(0, 292, "far", 8, 400.0), line(0, 600, "Fig. 4. One two three four", 9), line(0, 700, "Fig. 5. too short", 9)]
    graphics = [("d", 0, 0, 200.0, 105.0, 290.0, 280.0, "h2"), ("d", 0, 1, 100.0, 100.0, 190.0, 280.0, "h1"), ("d", 0, 2, 100.0, 640.0, 150.0, 660.0, "h3"), ("d", 1, 0, 10.0, 10.0, 40.0, 40.0, ""), ("d", 1, 1, 45.0, 10.0, 80.0, 40.0, ""), ("d", 1, 2, 300.0, 300.0, 340.0, 340.0, "")]
    kinds, objects, members, _, _ = documents(spark, rows, 2, graphics=graphics)
    assert kinds[0, "Figure 3: Two panels that"] == kinds[0, "share an axis"] == kinds[0, "(a) left"] == "caption"
    assert kinds[0, "far"] == kinds[0, "Running text goes on"] == kinds[0, "Fig. 5. too short"] == "body"
    named = {(o.kind, o.number): o for o in objects.values()}
    first = named["figure", "3"]
    assert first.caption == "Figure 3: Two panels that share an axis" and (first.x0, first.y0) == (72.0, 100.0)
    assert sorted(m.graphic for m in members if m.object_id == first.object_id and m.graphic is not None) == [0, 1]
    assert [m.graphic for m in members if m.object_id == named["figure", "4"].object_id and m.graphic is not None] == [2]
    assert sorted((o.x0, o.x1) for o in objects.values() if o.page == 1) == [(10.0, 80.0), (300.0, 340.0)]


def test_tables_go_as_far_as_their_rules(spark):
    row = lambda base, k: line(0, base, "", words=[(f"a{k}", 72), (f"b{k}", 200)])
    rows = [line(0, 100, "Table 1: Numbers", 9), row(120, 1), row(132, 2), line(0, 160, "After the table"), line(0, 700, "Table 2: Above the caption", 9), row(660, 8), row(680, 9), line(0, 600, "Before the table")]
    rules = [("d", 0, 72.0, y, 300.0, y + 1) for y in (108.0, 140.0, 650.0, 690.0)]
    kinds, objects, members, _, _ = documents(spark, rows, rules=rules)
    assert [kinds[0, t] for t in ("a1 b1", "a2 b2", "a8 b8", "a9 b9")] == ["table"] * 4 and kinds[0, "After the table"] == kinds[0, "Before the table"] == "body"
    one = next(o for o in objects.values() if o.number == "1")
    assert (one.y1, one.x1) == (141.0, 300.0) and sum(m.object_id == one.object_id for m in members) == 3


@pytest.mark.parametrize("text,reaches", [(None, True), ("a line of running text", False)])
def test_long_tables_without_inner_rules(spark, text, reaches):
    rows = [line(0, 100, "Table 1: Long", 9), *(line(0, 130 + 20 * k, "", words=[(f"a{k}", 72), (f"b{k}", 200)]) for k in range(14))] + ([line(0, 405, text)] if text else [])
    kinds, _, _, _, _ = documents(spark, rows, rules=[("d", 0, 72.0, y, 300.0, y + 1) for y in (110.0, 420.0)])
    assert (kinds[0, "a13 b13"] == "table") == reaches


def test_tables_without_rules_in_numbered_documents(spark):
    rows = [line(0, 100, "Table 1: Bare", 9), line(0, 115, "r1 r2"), line(0, 130, "r3 r4"), line(0, 150, "Running text", num=5), line(0, 170, "loose")]
    kinds, _, _, _, _ = documents(spark, rows)
    assert kinds[0, "r1 r2"] == "caption" or kinds[0, "r1 r2"] == "table"
    assert kinds[0, "Running text"] == kinds[0, "loose"] == "body"


def test_equations_take_the_display_lines_around(spark):
    rows = [line(0, 100, "We have the relation"), line(0, 115, "x = y", x=150.0), line(0, 130, "", x=150.0, words=[("a", 150), ("=", 170), ("b", 190), ("(3)", 490)]), line(0, 145, "+ c", x=160.0), line(0, 160, "", words=[("d", 150), ("(A.1)", 480)]), line(0, 175, "and so on"), line(0, 300, "", words=[("e", 150), ("(4)", 490)], num=9)]
    kinds, objects, _, _, _ = documents(spark, rows)
    assert kinds[0, "x = y"] == kinds[0, "a = b (3)"] == kinds[0, "+ c"] == kinds[0, "d (A.1)"] == "equation"
    assert kinds[0, "We have the relation"] == kinds[0, "and so on"] == kinds[0, "e (4)"] == "body"
    assert [(o.number, o.caption) for _, o in sorted(objects.items())] == [("3", "x = y a = b (3) + c"), ("A.1", "d (A.1)")]


def test_sections_from_the_outline_and_without(spark):
    rows = [line(0, 100, "1 Introduction", 14), line(0, 120, "some text"), line(0, 140, "1.1 Data sets", 12), line(0, 160, "more"), line(1, 100, "A Extra", 14), line(1, 300, "A Extra", 14)]
    outline = [("d", 0, 0, "Introduction", 1, 90.0), ("d", 0, 1, "Data sets", 2, None), ("d", 1, 2, "A Extra", 1, None), ("d", 1, 3, "A Extra", 1, None), ("d", 1, 4, "Nowhere", 1, None)]
    _, _, _, sections, lines = documents(spark, [list(r) for r in rows], 2, outline=outline)
    assert [(s.number, s.title, s.level, s.line_no) for s in sections] == [("1", "Introduction", 1, 0), ("1.1", "Data sets", 2, 2), ("", "A Extra", 1, 0), ("", "A Extra", 1, 1)]
    assert {(r.page, r.line_no): r.section_id for r in lines.collect()} == {(0, 0): 0, (0, 1): 0, (0, 2): 1, (0, 3): 1, (1, 0): 2, (1, 1): 3}
    _, _, _, sections, _ = documents(spark, [list(r) for r in rows], 2)
    assert [(s.number, s.title, s.level) for s in sections] == [("1", "Introduction", 1), ("1.1", "Data sets", 2), ("A", "Extra", 1), ("A", "Extra", 1)]


def test_caption_probe_and_reading_order(spark):
    items = spark.createDataFrame([("d", 0, 0, "Figure"), ("d", 0, 1, "3"), ("d", 0, 2, ": x"), ("d", 1, 0, "Figure shows"), ("d", 2, 0, "Table A1. Yields")], "doc_id string, page int, seq int, str string")
    assert sorted(r.page for r in S.probe_captions(items).collect()) == [0, 2]
    parts = spark.createDataFrame([("k", 1, 200.0, 100.0, 1.0, 1.0), ("k", 2, 10.0, 105.0, 1.0, 1.0), ("k", 3, 10.0, 130.0, 1.0, 1.0)], "key string, id int, x0 double, y0 double, x1 double, y1 double")
    assert [r.id for r in S.reading_order(parts, ["key"]).orderBy("place").collect()] == [2, 1, 3]
    assert S.mark_contents(spark.createDataFrame([], "doc_id string, page int, line_no int, num int, text string, kind string")).select(F.count("*")).first()[0] == 0
