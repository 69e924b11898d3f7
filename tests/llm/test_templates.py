"""The template deduction of page text, against explicit occurrence vectors."""

import random
from collections import Counter, defaultdict

from collatrix.llm import page_text

SHAPE = "page_id long, url string, html string"
NOTICE = "<div class=box><p>Read us every day</p></div><div class=box2><p>Tell a friend</p></div>"
PAGE = "<body><ul class=top><li><a href=/>Home</a></ul><article><h1>Title %d</h1><p>Body of page %d, long enough to be the article</p>{}<p>Last words %d</p></article><p class=end>Imprint</p></body>"


def pages_of(spark, host, pages, first=0):
    return spark.createDataFrame([(first + i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], SHAPE)


def test_classes_equal_explicit_occurrence_vectors(spark):
    rng = random.Random(4)
    blocks = ["<p class=a>A</p>", "<div id=b><p>B</p></div>", "<ul><li>x<li>y</ul>", "<p>often</p><p>often</p>", "<h2>C</h2>"]
    pages = [f"<body>{''.join(b for b in blocks if rng.random() < 0.8)}<article><p>own {i}</p></article></body>" for i in range(12)]
    vectors = defaultdict(lambda: [0] * len(pages))
    for n, html in enumerate(pages):
        units = page_text.units_of(html)
        counts = Counter([("path", u.path, "") for u in units] + [("text", u.path, u.text) for u in units])
        for token, count in counts.items():
            vectors[token][n] = count
    groups = defaultdict(set)
    for token, vector in vectors.items():
        if sum(map(bool, vector)) >= max(page_text.LEAST_PAGES, page_text.LEAST_SHARE * len(pages)):
            groups[tuple(vector)].add(token)
    key = lambda t: page_text.key_of("path", t[1]) if t[0] == "path" else page_text.key_of("text", t[1], t[2])
    wanted = {frozenset(map(key, g)) for g in groups.values() if len(g) > 1 or any(t[0] == "path" for t in g)}
    frame = spark.createDataFrame([("h", str(i), p) for i, p in enumerate(pages)], "host string, page string, html string")
    got = [frozenset(m["token"] & page_text._ALL for m in r.members) for r in page_text.classes_of(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 3


def test_template_texts_go_inside_articles(spark):
    html = [PAGE.format(NOTICE) % (i, i, i) for i in range(6)]
    got = {r.page_id: r.text for r in page_text.extract(pages_of(spark, "h.org", html)).collect()}
    alone = page_text.main_text(page_text.units_of(html[0]), page_text.Template(None))
    assert "Read us every day" in alone
    assert got == {i: f"Title {i}\n\nBody of page {i}, long enough to be the article\n\nLast words {i}" for i in range(6)}


def test_copies_of_one_article_stay_whole(spark):
    same = PAGE.format("") % (1, 1, 1)
    got = {r.text for r in page_text.extract(pages_of(spark, "h.org", [same] * 5 + [same.replace("Last words 1", f"Seen on day {i}") for i in range(3)])).collect()}
    assert got == {f"Title 1\n\nBody of page 1, long enough to be the article\n\n{end}" for end in ("Last words 1", "Seen on day 0", "Seen on day 1", "Seen on day 2")}


def test_texts_out_of_order_are_content():
    member = lambda place, path, text: {"place": place, "token": page_text.key_of("text", path, text), "path": path, "is_text": True, "chars": 0, "links": 0, "level": 0, "out": False}
    template = page_text.Template([{"members": [member(1.0, "body>p", "one"), member(2.0, "body>p", "two")]}])
    units = lambda html: page_text.units_of(f"<body>{html}</body>")
    assert template.fresh(units("<p>one</p><p>own</p><p>two</p>")) == [False, True, False]
    assert template.fresh(units("<p>two</p><p>own</p><p>one</p>")) == [True, True, True]


def test_classes_nest_in_gaps():
    member = lambda place, is_text: {"place": place, "is_text": is_text}
    outer = {"members": [member(1.0, False), member(5.0, True), member(9.0, False)]}
    inner = {"members": [member(2.0, True), member(3.0, True), member(7.0, True), member(8.0, False)]}
    lone = {"members": [member(2.5, True), member(6.0, True)]}
    assert [[m["place"] for m in p] for p in page_text.nested([outer, inner, lone])] == [[1.0, 5.0, 9.0], [2.0, 3.0], [7.0, 8.0]]


def test_clashing_names_and_odd_rows(spark):
    rows = [(i, f"http://h.org/{i}", PAGE.format("") % (i, i, i), "x", "y", "z") for i in range(5)] + [(None, None, None, None, None, None), (1, "http://h.org/1", "<p>" + "very long text " * 150_000, "a", "b", "c")]
    frame = spark.createDataFrame(rows, SHAPE + ", `_html` string, host string, text string")
    got = page_text.extract(frame).collect()
    assert len(got) == 7 and got[0].__fields__ == ["page_id", "url", "html", "_html", "host", "text", "n_chars"]
    assert sorted(r.n_chars for r in got)[-1] == len("very long text " * 150_000) - 1
    assert page_text.extract(frame.where("false")).count() == 0
