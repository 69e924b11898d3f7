import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))


def test_stages_do_their_work(spark):
    rng = random.Random(11)
    clean = [words(rng, 120) for _ in range(30)]
    passage = words(rng, 60)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "s0", 0), (101, clean[1].replace("w", "w", 1) + " end", "en", "s1", 0), (102, "too short", "en", "s1", 0), (103, "spam spam ham " * 60, "en", "s2", 0)]
    rows += [(104, words(rng, 80) + " " + passage, "en", "s0", 0), (105, words(rng, 80) + " " + passage, "en", "s0", 0), (106, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, None).persist()
        seen[name] = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    ids = {name: {r.doc_id for r in found} for name, found in seen.items()}
    assert ids["quality_rules"] == set(range(30)) | {100, 101, 104, 105}
    assert ids["near_dedup"] == ids["passage_dedup"] == set(range(30)) | {104, 105}
    texts = {r.doc_id: r.text for r in seen["passage_dedup"]}
    assert passage in texts[104] and passage not in texts[105] and all(texts[i] == clean[i] for i in range(30))
    assert all(r.n_chars == len(r.text) for r in seen["passage_dedup"])
    assert ids["source_mix"] <= ids["passage_dedup"]
    assert len(seen["tokenize"]) == len(seen["source_mix"]) and all(r.n_tokens == len(r.ids) > 0 for r in seen["tokenize"])


def test_run_covers_documents(spark, data):
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
