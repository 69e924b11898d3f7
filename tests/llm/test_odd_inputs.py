"""Empty tables, very long texts and columns whose names clash, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from collatrix.llm import ann, bpe, chat, mixing, page_text, queries, repetition, simhash, site_quality, suffix_dedup, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["_id", "_key", "_spans", "_payloads", "size", "source_size", "target", "rate", "copies", "taken", "id", "node", "label", "fp", "bits", "_gone", "_size", "_copies", "_column0", "html", "host", "_text", "_host", "p_toxic", "kept_"]


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def clashing_docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), *(f"{c}{i}" for c in CLASHING)) for i, t in enumerate(texts)]
    schema = T.StructType([*T._parse_datatype_string(DOCS).fields, *(T.StructField(c, T.StringType()) for c in CLASHING)])
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_every_column(spark, name, stage):
    rng = random.Random(1)
    texts = [words(rng, 80) for _ in range(6)] + [None, ""]
    docs = clashing_docs(spark, texts)
    got = stage(spark, docs, "").collect()
    assert got and got[0].__fields__ == docs.columns
    for r in got:
        assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHING)


def test_last_stage_keeps_other_columns(spark):
    docs = clashing_docs(spark, ["one two", None])
    got = {r.doc_id: r for r in corpus_pipeline.tokenize(spark, docs, "").collect()}
    assert got[0].size == "size0" and got[0].n_tokens == len(got[0].ids) > 0 and got[1].n_tokens == 0
    assert corpus_pipeline.tokenize(spark, docs.select("doc_id", "text"), "").columns == ["doc_id", "n_tokens", "ids"]


def test_operators_with_clashing_columns(spark):
    docs = clashing_docs(spark, ["one two three", "one two three", None])
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    path = queries.tokenizer_path()
    found = [
        simhash.near_duplicates(docs), suffix_dedup.report(docs), repetition.apply_rules(docs), bpe.decode(bpe.encode(docs, path), path), token_counts.token_counts(docs, path), mixing.mix(docs),
        site_quality.judge(docs, labels, F.col("source"), F.col("lang")),
    ]
    assert [f.count() for f in found] == [3] * len(found)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    log = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = queries.tokenizer_path()
    found = [
        page_text.extract(pages), bpe.decode(bpe.encode(docs, path), path), suffix_dedup.report(docs), simhash.near_duplicates(docs), mixing.mix(docs), site_quality.judge(docs, labels, F.col("source"), F.col("lang")),
        ann.nearest(vectors, vectors), token_counts.token_counts(docs, path), repetition.apply_rules(docs), chat.digests(chat.format_chats(log)), *(stage(spark, docs, "") for _, stage in corpus_pipeline.STAGES),
    ]
    assert [f.count() for f in found] == [0] * len(found)


def test_very_long_texts(spark):
    """Two texts of more than 2 MB that share their second half, beside short ones."""
    rng = random.Random(3)
    half = words(rng, 150_000)
    texts = [words(rng, 150_000) + " " + half, words(rng, 150_000) + " " + half, "short one"]
    docs = clashing_docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.report(docs).collect()}
    assert removed[0] == removed[2] == 0 and abs(removed[1] - len(half)) <= 8
    path = queries.tokenizer_path()
    decoded = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    counts = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    assert decoded == dict(enumerate(texts)) and all(counts[i].n_bytes == len(t) for i, t in enumerate(texts))
    rules = {r.doc_id: r for r in repetition.apply_rules(docs).collect()}
    assert rules[0].n_words == 300_000 and rules[0].kept and len({r.component_id for r in simhash.near_duplicates(docs).collect()}) == 3
    assert simhash.one_of_each(docs).count() == 3 and mixing.mix(docs).where("size = 300000").count() == 2
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    assert site_quality.judge(docs, labels, F.col("source"), F.col("lang")).where("p_quality is null").count() == 0
    log = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(log)).first().loss_chars == sum(map(len, texts))


def test_rules_reject_what_repeats(spark):
    """Documents that the base rules let pass: long copied passages go, clean texts stay."""
    rng = random.Random(5)
    clean = [words(rng, 300) for _ in range(5)]
    passage = words(rng, 130)
    texts = [*clean, f"{passage} {words(rng, 400)} {passage}", " ".join([words(rng, 15)] * 2 + [words(rng, 30)])]
    got = {r.doc_id: r for r in repetition.apply_rules(clashing_docs(spark, texts).select("doc_id", "text")).collect()}
    assert all(got[i].kept for i in range(5))
    assert not got[5].base_failed and not got[5].kept
