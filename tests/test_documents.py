from collatrix.operators import documents as D

LINES = "doc_id string, page int, line_no int, kind string, object_id int, object_kind string, first_line boolean, words array<struct<norm:string,box:struct<x0:double,y0:double,x1:double,y1:double>>>"


def line(n, kind, words, obj=None, obj_kind=None, first=False, doc="d", gap=4.0):
    placed, x = [], 0.0
    for w in words.split():
        placed.append((w, (x, 0.0, x + 5 * len(w), 10.0)))
        x += 5 * len(w) + gap
    return (doc, 0, n, kind, obj, obj_kind, first, placed)


def test_tokens_of_lines(spark):
    rows = [
        line(0, "header", "Page one"), line(1, "body", "a long exam-"), line(2, "body", "ple of 497 052 053 events"), line(3, "body", "Well-"), line(4, "body", "Known but"), line(5, "caption", "Figure 3: The fit", 4, "figure", True),
        line(6, "caption", "goes 3: on", 4, "figure"), line(7, "equation", "x = y (13)", 5, "equation", True), line(8, "footnote", "#fn note"), line(9, "body", "wide", gap=0.0),
    ]
    close = [(*r[:7], [(w, (i * 20.0, 0.0, i * 20.0 + 18.0, 10.0)) for i, (w, _) in enumerate(r[7])]) for r in rows]
    got = D.tokens_of_lines(spark.createDataFrame(close, LINES)).orderBy("tok").collect()
    assert [r.norm for r in got] == ["a", "long", "example", "of", "497052", "053", "events", "Well-", "Known", "but", "Figure", "#:", "The", "fit", "goes", "3:", "on", "x", "=", "y", "(#)", "#fn", "note", "wide"]
    assert {r.norm: r.stream for r in got if r.norm in ("fit", "note", "y", "wide")} == {"fit": "float:4", "note": "notes", "y": "body", "wide": "body"}
    apart = spark.createDataFrame([(*r[:7], [(w, (i * 60.0, 0.0, i * 60.0 + 18.0, 10.0)) for i, (w, _) in enumerate(r[7])]) for r in rows], LINES)
    assert "497" in [r.norm for r in D.tokens_of_lines(apart).collect()]


def frames(spark):
    text = lambda doc, words, stream, at: [(doc, at + i, w, 0, 0, stream) for i, w in enumerate(words.split())]
    a = text("a", "the amber lamp is lit here", "body", 0) + text("a", "Figure #: share of events in all bins", "float:0", 6) + text("a", "and so on", "body", 14) + text("a", "#fn see there", "notes", 17) + text("a", "Table #: only old rows", "float:1", 20)
    b = text("b", "Figure #: share of events in some bins", "float:5", 0) + text("b", "the cobalt lamp is lit here and so on", "body", 8) + text("b", "#fn see here", "notes", 17)
    tokens = spark.createDataFrame(a + b, "doc_id string, tok int, norm string, page int, line_no int, stream string")
    objects = spark.createDataFrame([("a", 0, "figure", "1", ["h"]), ("a", 1, "table", "1", []), ("b", 5, "figure", "2", ["h"])], "doc_id string, object_id int, kind string, number string, hashes array<string>")
    return spark.createDataFrame([("a", "b")], "a string, b string"), tokens, objects


def test_floats_pair_and_streams_align(spark):
    pairs, tokens, objects = frames(spark)
    floats = D.pair_floats(pairs, tokens, objects)
    assert [(r.a_object, r.b_object, round(r.score, 4)) for r in floats.collect()] == [(0, 5, round(2 * 7 / 16 + 0.3, 4))]
    rows = D.align_documents(pairs, tokens, floats).collect()
    state = {(r.side, r.tok): (r.other, r.state) for r in rows}
    assert len(rows) == 25 + 20 and state["a", 1] == (None, "changed") and state["a", 0] == (8, "same") and state["a", 6] == (0, "same")
    assert state["a", 11][1] == state["a", 11][1] and state["a", 20] == (None, "changed") and state["a", 17] == (17, "same") and state["a", 19] == (None, "changed")
    runs = {(r.side, r.tok): r.run for r in D.run_lengths(D.align_documents(pairs, tokens, floats)).collect()}
    assert runs["a", 0] == 1 and runs["a", 2] == 4 and runs["a", 14] == 5
    starts = spark.createDataFrame([("a", "b", 1, 20)], "a string, b string, object int, tok int")
    assert [tuple(r) for r in D.insertion_places(D.align_documents(pairs, tokens, floats), starts).collect()] == [("a", "b", 1, 19)]


def test_moves_are_summed_up(spark):
    words = ["word" + c * 3 for c in "abcdefghijklmnop"]
    rest = [c * n + end for n, end in ((5, "x"), (4, "y")) for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [("a", i, w, 0, 0, "body") for i, w in enumerate(rest[:10] + words + rest[10:])] + [("b", i, w, 0, 0, "body") for i, w in enumerate(rest + words)]
    tokens = spark.createDataFrame(rows, "doc_id string, tok int, norm string, page int, line_no int, stream string")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    aligned = D.align_documents(pairs, tokens, spark.createDataFrame([], "a string, b string, a_object int, b_object int"))
    got = D.move_summaries(aligned, tokens).collect()
    assert [(r.words, r.first, r.after_a, r.after_b) for r in got] == [(16, " ".join(words[:10]), " ".join(rest[4:10]), " ".join(rest[-6:]))]
