import numpy as np
import pytest
from pyspark.sql import functions as F

from collatrix.operators import layout as L

FLIP = [1.0, 0.0, 0.0, -1.0, 0.0, 800.0]
ITEMS = "doc_id string, page int, seq int, str string, transform array<double>, width double, font string, ascent double, descent double"
SIZES = "doc_id string, page int, width double, height double, viewport array<double>"
PIECES = "doc_id string, page int, seq long, text string, x0 double, x1 double, base double, size double, top double, bottom double, space_before boolean, font string"


def item(seq, text, x, y, size=10.0, width=None, page=0, turn=None):
    return ("d", page, seq, text, turn or [size, 0.0, 0.0, size, float(x), float(y)], float(width if width is not None else 5 * len(text)), "f", None, None)


def sizes(spark, pages=1):
    return spark.createDataFrame([("d", p, 600.0, 800.0, FLIP) for p in range(pages)], SIZES)


def piece(seq, text, x0, base, size=10.0, width=None, page=0, space=False, font="f"):
    return ("d", page, seq, text, float(x0), float(x0 + (width if width is not None else 5 * len(text))), float(base), float(size), float(base - 0.75 * size), float(base + 0.25 * size), space, font)


def test_items_become_pieces(spark):
    rows = [item(0, "mi ll", 100, 700, width=50), item(1, "on", 150, 700), item(2, " ", 160, 700), item(3, "end ", 170, 700), item(4, "x", 190, 700), item(5, "up", 5, 5, turn=[0.0, 9.0, -9.0, 0.0, 5.0, 5.0]), item(6, "", 0, 0), item(7, "z", 200, 700)]
    got = L.pieces_of(spark.createDataFrame(rows, ITEMS), sizes(spark)).orderBy("seq").collect()
    assert [(r.text, r.space_before) for r in got] == [("mi", True), ("ll", True), ("on", False), ("end", True), ("x", True), ("z", True)]
    whole = 0.833 + 0.278 + 0.333 + 2 * 0.278
    assert got[0].x0 == 100 and got[0].x1 == pytest.approx(100 + 50 * (0.833 + 0.278) / whole) and got[1].x1 == pytest.approx(150)
    assert (got[0].base, got[0].size, got[0].top, got[0].bottom) == (100.0, 10.0, 92.5, 102.5)


def test_sideways_pages_turn_and_back(spark):
    up = [item(k, "abcdefghij", 50, 20 * k, turn=[0.0, 9.0, -9.0, 0.0, 50.0 + 12 * k, 40.0]) for k in range(8)]
    frame = spark.createDataFrame(up + [item(9, "only a few", 10, 10, page=1)], ITEMS)
    turns = {r.page: r.turn for r in L.sideways_turns(frame, sizes(spark, 2)).collect()}
    assert turns == {0: [0.0, 1.0, -1.0, 0.0, 800.0, 0.0], 1: None}
    box = spark.range(1).select(F.struct(F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(30.0).alias("x1"), F.lit(25.0).alias("y1")).alias("b"), F.array(*map(F.lit, turns[0])).alias("t"))
    assert tuple(box.select(L.turned_back(F.col("b"), F.col("t")).alias("r")).first().r) == (20.0, 770.0, 25.0, 790.0)
    upright = L.lines_of_documents(frame, sizes(spark, 2), spark.createDataFrame([], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"))[0]
    assert upright.where("page = 0").count() > 0


def test_body_and_line_numbers(spark):
    rows, n = [], 0
    for page in range(2):
        for line in range(30):
            n += 1
            base = 100 + 20 * line
            rows.append(piece(3 * n, str(n), 60 - 5 * len(str(n)), base, 6, page=page))
            rows.append(piece(3 * n + 1, "running", 72, base, page=page, width=60, space=True))
            rows.append(piece(3 * n + 2, "text", 300, base, page=page, width=200, space=True))
    rows += [piece(1000 + k, str(7 * k % 90), 580, 100 + 20 * k, 10, page=0) for k in range(20)]
    frame = spark.createDataFrame(rows, PIECES)
    body = L.body_geometry(frame)
    assert tuple(body.first()) == ("d", 10.0, 72.0, 500.0)
    marks = L.line_marks(frame, body)
    assert sorted(r.num for r in marks.collect()) == list(range(1, 61))
    text = L.text_pieces(frame, spark.createDataFrame([("d", 0, 0.0, 0.0, 1.0, 1.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"), marks, body)
    lines = L.build_lines(text, marks, body).orderBy("page", "line_no").collect()
    assert [r.num for r in lines if r.page == 1] == list(range(31, 61)) and lines[40].text == "running text"


def test_text_in_and_beside_figures_goes(spark):
    rows = [piece(0, "Running", 72, 300, 10, font="a"), piece(1, "label", 110, 150, 8, font="a"), *(piece(2 + k, "t", 120 + 9 * k, 120, 8, font="plot") for k in range(6)), piece(9, "tick", 95, 120, 8, font="plot"), piece(10, "title", 120, 92, 7, font="a"), piece(11, "Caption", 110, 260, 8, font="a")]
    graphics = spark.createDataFrame([("d", 0, 100.0, 100.0, 200.0, 200.0), ("d", 0, 0.0, 0.0, 600.0, 800.0), ("d", 0, 0.0, 0.0, 10.0, 10.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    frame = spark.createDataFrame(rows, PIECES)
    body = spark.createDataFrame([("d", 10.0, 72.0, 500.0)], "doc_id string, body_size double, body_left double, body_right double")
    kept = L.kept_graphics(graphics, sizes(spark))
    assert kept.count() == 1
    got = L.text_pieces(frame, kept, spark.createDataFrame([], "doc_id string, page int, seq long, base double, num int"), body)
    assert sorted(r.text for r in got.collect()) == ["Caption", "Running"]


def page_of(*pieces):
    return L.Pieces(*map(list, zip(*[(p[3], p[4], p[5], p[6], p[7], p[8], p[9], p[10]) for p in pieces])))


def texts(page, marks=(), body=10.0):
    return [(num, " ".join(t for t, _, _ in words)) for _, _, num, words in L.lines_of_page(page, list(marks), body)]


def test_scripts_join_their_line():
    page = page_of(piece(0, "a sample of 10", 72, 100, width=70, space=True), piece(1, "−", 143, 96, 7, width=5), piece(2, "3", 148, 96, 7, width=4), piece(3, "is taken from there", 160, 100, space=True, width=100))
    assert texts(page) == [(None, "a sample of 10−3 is taken from there")]


def test_footnote_marks_are_words():
    page = page_of(piece(0, "rare", 72, 100, space=True, width=20), piece(1, "decays", 97, 100, space=True, width=30), piece(2, "1", 127, 96, 7, width=4), piece(3, "are studied here", 136, 100, space=True, width=80))
    (_, _, _, words), = L.lines_of_page(page, [], 10.0)
    assert [(t, n) for t, _, n in words] == [("rare", False), ("decays", False), ("1", True), ("are studied here", False)]


def test_stacked_scripts_are_read_run_by_run():
    page = page_of(piece(0, "4.52", 72, 100, width=20), piece(1, "+0", 93, 96, 7, width=8), piece(2, "−0", 93, 104, 7, width=8), piece(3, ".31", 101, 96, 7, width=10), piece(4, ".27", 101, 104, 7, width=10))
    assert L.word_text(page, [0, 1, 2, 3, 4]) == "4.52+0.31−0.27"


def test_rows_cluster_around_their_first_piece():
    page = page_of(*(piece(k, "x", 72 + 10 * k, 100 + 0.6 * k) for k in range(4)))
    assert [len(r.at) for r in L.rows_of(page, np.arange(4))] == [2, 2]


def test_small_rows_fold_and_numbers_anchor():
    page = page_of(piece(0, "E = mc", 200, 300, 10, width=30), piece(1, "2", 215, 296, 6, width=3), piece(2, "short", 72, 330, 10, width=25))
    assert texts(page) == [(None, "E = mc2"), (None, "short")]
    assert texts(page, [(331.0, 7)])[-1] == (7, "short")
    assert texts(page_of(piece(0, "√", 100, 93, 10, width=6), piece(1, "x is some root of it", 106, 100, 10, width=90)))[0][1] == "√x is some root of it"


def test_median_is_the_upper_one(spark):
    assert spark.createDataFrame([(1.0,), (2.0,), (5.0,), (9.0,)], "w double").agg(L.median("w").alias("m")).first().m == 5.0
