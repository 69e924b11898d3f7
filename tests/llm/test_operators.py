import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import xxhash

from collatrix.llm import ann, bpe, chat, mixing, near_copies, page_text, queries, repetition, simhash, site_quality, suffix_dedup, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def docs_of(spark, texts, source="s"):
    """Documents with ids from 0, and a column whose name clashes with results."""
    rows = [(i, t, "en", source, 0, "mine") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "one", "one", "zwei drei", "é" * 5000, "w " * 3000, "a\x00b", "line\nline\nline", "<|endoftext|> x"]


# ------------------------------------------------------------------------------------------------ 1
PAGE = (
    '<html><head><title>T</title><style>p{}</style><script>x="</p>"</script></head><body><nav><ul><li><a href=/>Home %d</a></ul></nav>'
    '<div class="ad">Buy %d</div><article><h1>Head &amp; %d</h1><p>First&nbsp; <b>bold<br>text %d<p>Second</article>'
    '<div id="comments"><article class="comment"><p>reader %d</p></article></div><form><p>mail</p></form><footer>&copy; f %d</footer></body>'
)


def test_pages_give_their_article(spark):
    rows = [(i, f"http://h.org/{i}", PAGE % ((i,) * 6)) for i in range(8)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://one.org/a", "<p>lone <b>text</p>after"), (103, "http://two.org", "<div><p>" + "long " * 2000)]
    got = {r.page_id: r for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i].text == f"Head & {i}\n\nFirst bold text {i}\n\nSecond"
        assert got[i].n_chars == len(got[i].text)
    assert got[100].text == got[101].text == ""
    assert got[102].text.startswith("lone text")
    assert got[103].n_chars == 5 * 2000 - 1


def test_elements_that_are_no_content():
    page = (
        "<body><div class='side-bar'>a</div><div id=topBar>b</div><header>c</header><article><header><h2>Title</h2></header><aside>d</aside><p>text &lt; more<div class='notice warning'>e</div>"
        "<p>kept<form>f<input></form><ul class='share_links'><li>g</ul><figure><figcaption>caption</figcaption></figure></article><section class=userComments><p>h</section><script>i</script>"
    )
    units = page_text.units_of(page)
    assert page_text.main_text(units, page_text.Template(None)) == "Title\n\ntext < more\n\nkept\n\ncaption"


def test_template_texts_and_containers_decide_without_articles(spark):
    page = "<body><div class=box><p>Same line on every page</p><p>Body %d %s</p></div><div class=x><a href=/>go</a></div></body>"
    rows = [(i, f"http://h.org/{i}", page % (i, "word " * 20)) for i in range(6)]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Body {i} {('word ' * 20).strip()}" for i in range(6)}


@pytest.mark.parametrize("page", [
    "<body class='no-sidebar'><p>%s</p></body>", "<body><main class='page with-sidebar'><p>%s</p></main></body>", "<body><article class='post has-comments'><p>%s</p></article></body>",
    "<body><div class='content social'><p>%s</p></div></body>", "<body class=has-header><div class='with-sidebar'><article><p>%s</p></article></div></body>",
])
def test_names_do_not_put_the_whole_article_out(page):
    rest = "<div class=sidebar><p>side</p></div><section id=comments><article class=comment><p>reader</p></article></section></body>"
    assert page_text.main_text(page_text.units_of(page.replace("</body>", rest) % "The article itself"), page_text.Template(None)) == "The article itself"


def test_all_sections_stay_without_articles(spark):
    page = "<body><div class=page><h1>Title %d</h1><div id=s1><p>First %d</p></div><div id=s2><p>Second, longer %d</p><ul><li><a href='/x'>go %d</a></ul></div></div></body>"
    rows = [(i, f"http://h.org/{i}", page % ((i,) * 4)) for i in range(6)] + [(9, "http://one.org", page % ((9,) * 4))]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {r[0]: f"Title {r[0]}\n\nFirst {r[0]}\n\nSecond, longer {r[0]}" for r in rows}


def test_template_texts_go_inside_content_elements(spark):
    page = "<body><%s><div class=x><p>Home</p></div><div class=y><p>Body %d</p></div><div class=z><p>Imprint</p></div></%s></body>"
    rows = [(10 * k + i, f"http://h{k}.org/{i}", page % (tag, i, tag.split()[0])) for k, tag in enumerate(("div id=content", "main")) for i in range(6)]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {r[0]: f"Body {r[0] % 10}" for r in rows}


# ------------------------------------------------------------------------------------------------ 2, 8
def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    random.seed(5)
    texts = ODD + ["".join(chr(random.choice([32, 65, 97, 48, 10, 0xE9, 0x4E2D, 0x1F600, 0x2003, 0x301])) for _ in range(200)) for _ in range(20)]
    rows = bpe.decode(bpe.encode(docs_of(spark, texts), path), path).collect()
    counts = {r.doc_id: r for r in token_counts.token_counts(docs_of(spark, texts), path).collect()}
    assert len(rows) == len(counts) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == text == library.decode(ids, skip_special_tokens=False)
        c = counts[r.doc_id]
        assert (c.n_tokens, c.n_bytes, c.over_limit) == (len(ids), len(text.encode()), len(ids) > 512)


def test_word_tables_start_anew(monkeypatch):
    path = queries.tokenizer_path()
    table = bpe.WordTable(path)
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    once = [table.encode([t])[0].tolist() for t in ("a b c d e", "f g", "a b")]
    monkeypatch.setattr(bpe, "MOST_WORDS", 10**6)
    assert once == [table.encode([t])[0].tolist() for t in ("a b c d e", "f g", "a b")]


# ------------------------------------------------------------------------------------------------ 3
def removed_by_brute_force(rows):
    first, out = {}, {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            first[w] = min(first.get(w, (i, p)), (i, p))
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (i, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeating_texts():
    random.seed(3)
    parts = ["".join(random.choice("abcd é") for _ in range(random.randint(90, 260))) for _ in range(8)]
    texts = []
    for _ in range(120):
        make = lambda: random.choice([random.choice(parts), random.choice(parts)[: random.randint(50, 130)], "a" * random.randint(0, 300), "xyz " * random.randint(0, 9)])
        texts.append("".join(make() for _ in range(random.randint(0, 6))))
    return texts + ODD


@pytest.mark.parametrize("hot", [1, 2048])
def test_repeated_strings_go(spark, monkeypatch, hot):
    texts = repeating_texts()
    plain = suffix_dedup.with_spans
    monkeypatch.setattr(suffix_dedup, "with_spans", lambda *a: plain(*a, hot_segments=hot))
    got = suffix_dedup.report(docs_of(spark, texts)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == removed_by_brute_force(list(enumerate(texts)))


def test_rows_of_one_id_and_null_ids(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(None, text), (1, text), (1, text), (2, "x" + text)]
    got = suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 0, 0), (True, 1, 150), (True, 1, 150), (True, 2, 150)]
    cut = suffix_dedup.without_repeats(docs_of(spark, [text, text + " tail"])).orderBy("doc_id").collect()
    assert [r.text for r in cut] == [text, " tail"] and cut[0].kept == "mine"


def test_deep_shallow_sorts():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (300, 100)).astype(np.uint8)
    rows[50:100] = rows[0]
    rows[100:150, :80] = rows[0, :80]
    order, group = suffix_dedup.deep_shallow(rows)
    keys = [bytes(r) for r in rows]
    assert [keys[i] for i in order] == sorted(keys)
    assert all((keys[order[k]] == keys[order[k - 1]]) == (group[k] == group[k - 1]) for k in range(1, 300))


def test_no_rows(spark):
    empty = docs_of(spark, ["x"]).where("false")
    for found in (suffix_dedup.report(empty), simhash.near_duplicates(empty), mixing.mix(empty), repetition.apply_rules(empty), simhash.one_of_each(empty), bpe.encode(empty, queries.tokenizer_path())):
        assert found.count() == 0


# ------------------------------------------------------------------------------------------------ 4
def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(150)] = rng.choice(words)
            texts.append(" ".join(copy))
    got = simhash.near_duplicates(docs_of(spark, texts)).collect()
    fp = [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in got} == {i: (fp[i], label[i]) for i in range(len(texts))}


def test_anchors_cover_the_threshold():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = int(rng.integers(0, 2**63))
        y = x
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            y ^= 1 << int(bit)
        index, key, home = simhash.anchors(np.array([[x], [y]], np.uint64), simhash.HALVES)
        assert set(key[(index == 0) & home]) & set(key[index == 1])


def test_large_groups_connect_like_all_pairs():
    rng = np.random.default_rng(6)
    fps = (rng.integers(0, 2**20, (150, 1)) << 3).astype(np.uint64)
    root = {i: i for i in range(150)}
    for a, b in zip(*simhash.forest(fps, 4)):
        old, new = root[int(a)], root[int(b)]
        root = {k: new if v == old else v for k, v in root.items()}
    near = np.bitwise_count(fps[:, None, 0] ^ fps[None, :, 0]) <= 4
    reach = np.linalg.matrix_power(near.astype(float), 1) > 0
    for _ in range(8):
        reach = (reach.astype(float) @ reach.astype(float)) > 0
    assert all((root[i] == root[j]) == bool(reach[i, j]) for i in range(150) for j in range(150))


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(900)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(6)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join(b[:50] + ["changed"] + b[51:]) for b in base] + [texts[0], texts[0]]
    got = sorted(r.doc_id for r in simhash.one_of_each(docs_of(spark, texts)).collect())
    assert got == [0, 1, 2, 3, 4, 5]


def test_near_copies_equal_brute_force_at_the_limit(spark):
    rng = random.Random(12)
    texts = [None, "", "one", "one", "two words"]
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        copy = list(base)
        for _ in range(max(1, round(len(base) * (0.01 + 0.03 * i / 60)))):
            copy[rng.randrange(len(base))] = "changed"
        texts += [" ".join(base), " ".join(copy), " ".join(base[:-1])]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    label = list(range(len(texts)))
    limits = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                limits += 4 * len(x | y) >= 4.4 * len(x & y) > 0
                label = [label[j] if v == label[i] else v for v in label]
    kept = sorted(r.doc_id for r in simhash.one_of_each(docs_of(spark, texts)).collect())
    assert limits > 20 and kept == sorted({label.index(v) for v in label})


def copies_at_the_limit(seed):
    rng = random.Random(seed)
    texts = [None, "", "one", "one"]
    for i in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        copy = list(base)
        for _ in range(max(1, round(len(base) * (0.01 + 0.03 * i / 30)))):
            copy[rng.randrange(len(base))] = "changed"
        texts += [" ".join(base), " ".join(copy), " ".join(base[:-1])]
    return texts


def test_near_copies_are_the_same_with_many_links(spark, monkeypatch):
    docs = docs_of(spark, copies_at_the_limit(13))
    few = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    monkeypatch.setattr(near_copies, "LAST_LINKS", 0)
    monkeypatch.setattr(near_copies, "MOST_BROADCAST", 0)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == few


def test_few_links_take_few_tasks(spark):
    docs, width, context = docs_of(spark, copies_at_the_limit(14)), 24, spark.sparkContext
    conf = {"spark.sql.shuffle.partitions": str(width), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    context.setJobGroup("few links", "few links")
    try:
        simhash.one_of_each(docs).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = context.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("few links") for s in seen.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := seen.getStageInfo(s)))
    assert 0 < tasks < 100 * width


# ------------------------------------------------------------------------------------------------ 5
def test_mix_meets_targets(spark):
    rows = [(i, "w " * (10 + i % 7), ["a", "b", "c", None][i % 4] if i % 9 else "tiny") for i in range(400)]
    rows += [(900, None, "void"), (901, "", "void"), (902, "x y", "a"), (902, "x y", "a")]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))).collect()
    assert len(mixed) == len(rows)
    size, names = {}, sorted({r[2] for r in rows if r[2] is not None}) + [None]
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            free.remove(s)
            left -= target[s]
    for r in mixed:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    for s in names:
        assert abs(sum(r.taken for r in mixed if r.source == s) - target[s]) <= 0.25 * target[s] + 20
    assert len({(r.doc_id, r.copies) for r in mixed if r.doc_id == 902}) == 1


# ------------------------------------------------------------------------------------------------ 6
def test_held_out_labels(spark):
    rng = random.Random(9)
    plain, bad, poor = [f"w{i}" for i in range(300)], ["vile", "nasty", "awful"], ["|", "%%%", "&&&"]
    docs, labels = [], []
    for i in range(1200):
        toxic, low = int(i % 5 == 0), int(i % 7 == 3)
        words = [rng.choice(plain) for _ in range(60)] + [rng.choice(bad)] * (2 * toxic) + [rng.choice(poor)] * (8 * low)
        rng.shuffle(words)
        docs.append((i, " ".join(words), f"host{i % 8}" if i % 11 else None, "en"))
        labels.append((i, 1 - low, toxic))
    docs += [(5000, None, "host1", "en"), (5001, "", None, None), (5002, "x", "lonely", "xx")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame([r for r in labels if r[0] % 3] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in site_quality.judge(frame, known, F.col("source"), F.col("lang")).collect()}
    assert len(got) == len(docs)
    held = [r for r in labels if r[0] % 3 == 0]
    right = sum(got[i].kept == (q == 1 and t == 0) for i, q, t in held) / len(held)
    assert right > 0.95
    none = site_quality.judge(frame, known.where("false"), F.col("source"), F.col("lang"))
    assert none.where("p_quality is null or p_toxic is null").count() == 0


# ------------------------------------------------------------------------------------------------ 7
def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[300:420] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] + [1.0] * 15), (1080, [float("inf")] + [1.0] * 15), (1100, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(frame, frame.where("vec_id % 20 = 0"), shard_rows=300).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 900, 20))
    hits = 0
    for q, listed in found.items():
        listed.sort()
        assert [r for r, _, _ in listed] == list(range(1, 21)) and q not in [v for _, v, _ in listed]
        score = x @ x[q]
        assert all(s == pytest.approx(score[v]) for _, v, s in listed)
        assert listed == sorted(listed, key=lambda t: (-t[2], t[1]))
        score[q] = -np.inf
        best = sorted(range(900), key=lambda i: (-score[i], i))[:20]
        hits += len(set(best) & {v for _, v, _ in listed})
    assert hits / (20 * len(found)) >= 0.95
    few = spark.createDataFrame(rows[:3], frame.schema)
    assert ann.nearest(few, few).count() == 6


# ------------------------------------------------------------------------------------------------ 9
def brute_repeats(words, least):
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    threes, long_ones = set(), set()
    for i, k in enumerate(longest):
        threes |= set(range(i, i + 3)) if k >= 3 else set()
        long_ones |= set(range(i, i + k)) if k >= least else set()
    return len(threes), len(long_ones), max(longest, default=0)


def test_repeats_against_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        docs = [[rng.choice([b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 50))] for _ in range(rng.randint(1, 5))]
        found = repetition.repeats(docs, 5)
        assert [tuple(int(x[i]) for x in found) for i in range(len(docs))] == [brute_repeats(d, 5) for d in docs]


def test_rules(spark):
    rng = random.Random(2)
    clean = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    texts = [*ODD, clean, clean[:800] + "\n" + clean[:800], "a b # $ \n" * 4]
    got = {r.doc_id: r for r in repetition.apply_rules(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts) and got[len(ODD)].kept and not got[len(ODD) + 1].kept
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        lines = [x for x in (t or "").encode().split(b"\n") if x.split()]
        threes = brute_repeats(words, 12)[0] if len(words) < 500 else len(words)
        r = got[i]
        assert (r.n_words, r.word_chars) == (len(words), sum(len(w.decode()) for w in words))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>") and r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == threes
        assert r.base_failed == (len(words) < 50 or 100 * threes > 50 * len(words)) and not (r.base_failed and r.kept)
    assert repetition.apply_rules(docs_of(spark, texts), only_kept=True).columns == [c.split()[0] for c in DOCS.split(", ")]


# ------------------------------------------------------------------------------------------------ 10
def test_escapes_round_trip():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("\\<[lb|>/sINST]x") for _ in range(rng.randint(0, 12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and "<" not in safe and "[" not in safe
        assert chat.read_back(chat.render(text, text)[0]) == (text, text)


def test_logs_are_folded(spark):
    log = [
        (1, 0, "user", "hi", "message", None), (1, 1, "assistant", "he", "message", None), (1, 2, "", "llo", "delta", None), (1, 3, "user", "more", "message", None),
        (1, 4, "", "hello again", "regenerate", 1), (1, 5, "", "hey", "edit", 0), (2, 0, "assistant", "late", "delta", None), (None, 0, None, None, None, None),
    ]
    frame = spark.createDataFrame(log, "conv_id long, turn long, role string, text string, kind string, target long")
    made = chat.format_chats(frame, kind="kind", target="target").collect()
    said = {}
    for r in made:
        said.setdefault(r.conv_id, []).append((r.part, *chat.read_back(r.output), r.output[r.loss_start : r.loss_end] if r.loss_start is not None else None))
    assert said == {1: [(0, "user", "hey", None), (1, "assistant", "hello again", "hello again")], 2: [(0, "assistant", "late", "late")], None: [(0, "", "", None)]}


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "<b> [x] \\"), (1, 0, "user", None), (1, None, "system", "s"), (2, 0, "user", "q"), (2, 0, "user", "q")]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    turns = "system\ns\nuser\n\nassistant\n<b> [x] \\\n"
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (9, hashlib.sha256(b"<b> [x] \\").hexdigest())
    assert got[2].n_turns == 2 and got[2].loss_chars == 0


# ------------------------------------------------------------------------------------------------ all
def test_registered_queries_cover_their_tables(spark, data):
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    for name in ("op1_page_text", "op5_mixing", "op9_quality_rules", "op10_chat"):
        source = {"op1": "pages", "op10": "conversations"}.get(name.split("_")[0], "documents")
        rows = spark.read.parquet(f"{data}/{source}.parquet")
        n = rows.select("conv_id").distinct().count() + 1 if source == "conversations" else rows.count()
        assert found[name](spark, data).count() == n
