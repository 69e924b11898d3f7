from collatrix.operators import objects, windows
from collatrix.operators import objects as O

OBJECT = "pair_id int, id int, kind string, number string, caption string, page int, pages int, box struct<x0:double,y0:double,x1:double,y1:double>, hashes array<string>"


def made(spark, *rows):
    return spark.createDataFrame([(1, i, k, n, c, p, 10, (0.0, 0.0, 10.0, 10.0), h) for i, (k, n, c, p, h) in enumerate(rows)], OBJECT)


def test_tiers(spark):
    a = made(
        spark, ("figure", "1", "Figure 1: invariant mass of selected candidates in data", 1, ["x"]), ("figure", "2", "Figure 2: efficiency against momentum for both years of running", 2, [""]),
        ("table", "1", "Table 1: yields", 3, []), ("figure", "", "", 4, []), ("equation", "3", "short", 5, []),
    )
    b = made(
        spark, ("figure", "2", "Figure 2: something else entirely written here today", 1, ["x"]), ("figure", "3", "Figure 3: efficiency against momentum for the years of running", 2, [""]),
        ("table", "1", "Table 1: numbers", 3, []), ("figure", "", "", 4, []), ("equation", "3", "one long formula of many more words", 5, []),
    )
    none = spark.createDataFrame([], "pair_id int, a int, b int, score double")
    pairs = O.pair_objects(a, b, none)
    assert {(r.a, r.b, r.tier) for r in pairs.collect()} == {(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 3, 4)}
    assert [r.id for r in O.unpaired(a, pairs, "a").collect()] == [4]
    chosen = spark.createDataFrame([(1, 0, 1), (1, 1, None)], "pair_id int, a int, b int")
    assert {(r.a, r.b) for r in O.pair_objects(a, b, none, chosen).where("tier < 3").collect()} == {(0, 1)}


def test_panels(spark):
    kind = "key int, part int, hash string"
    a = spark.createDataFrame([(1, 0, "p"), (1, 1, "q"), (1, 2, "")], kind)
    b = spark.createDataFrame([(1, 0, "q"), (1, 1, "r")], kind)
    assert {(r.a_part, r.b_part, r.same) for r in O.pair_panels(a, b).collect()} == {(1, 0, True), (0, 1, False), (2, None, False)}


def test_pages(spark):
    best = spark.createDataFrame([(1, 2, 0, 0), (1, 2, 1, 2), (1, 2, 2, 3)], "a int, b int, b_page int, a_page int")
    pages = spark.createDataFrame([(1, 2, 4, 4)], "a int, b int, a_pages int, b_pages int")
    rows = O.pair_pages(best, pages).orderBy("seq").collect()
    assert [(r.b_page, r.a_page) for r in rows] == [(0, 0), (None, 1), (1, 2), (2, 3), (3, None)]


def test_look_alikes_keep_their_order(spark):
    pairs = spark.createDataFrame([("p", 0, 2), ("p", 1, 1), ("p", 2, 0), ("q", 0, 1), ("q", 1, 0)], "pair_id string, a int, b int")
    similar = spark.createDataFrame([("p", a, b) for a in range(3) for b in range(3)], "pair_id string, a int, b int")
    got = sorted(tuple(r) for r in objects.in_series_order(pairs, similar).collect())
    assert got == [("p", 0, 0), ("p", 1, 1), ("p", 2, 2), ("q", 0, 1), ("q", 1, 0)]


def test_scroll_anchors_rise_on_both_sides(spark):
    rows = spark.createDataFrame([("d", 1.0, 10.0), ("d", 2.0, 50.0), ("d", 2.0, 12.0), ("d", 3.0, 11.0), ("d", 4.0, 20.0)], "doc string, x double, y double")
    assert [tuple(r)[1:] for r in windows.rising_anchors(rows, "doc", "x", "y").orderBy("x").collect()] in ([(1.0, 10.0), (2.0, 12.0), (4.0, 20.0)], [(1.0, 10.0), (3.0, 11.0), (4.0, 20.0)])
