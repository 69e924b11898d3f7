from pyspark.sql import functions as F

from collatrix.functions import text as X


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_normal_forms(spark):
    rows = [("a`b",), ("x−y",), ("“q”",), ("soft­hyphen",), ("…",), ("ﬁt",), ("12 345",)]
    got = [r.n for r in spark.createDataFrame(rows, "t string").select(X.normalize_token("t").alias("n")).collect()]
    assert got == ["a'b", "x-y", '"q"', "softhyphen", "...", "fit", "12 345"]


def test_versions(spark):
    cases = {"note_v3.pdf": "v3", "note-v3_5.pdf": "v3.5", "X-V4R1.pdf": "v4r1", "draft.pdf": None, "rev12": None, "v2": "v2"}
    rows = spark.createDataFrame([(n,) for n in cases], "n string").select("n", X.name_version("n").alias("v")).collect()
    assert {r.n: r.v for r in rows} == cases
    assert one(spark, X.title_version(F.lit("Analysis note, Version 2.1 of May"))) == "v2.1"
    same = lambda a, b: one(spark, X.same_version(X.version_key(F.lit(a)), X.version_key(F.lit(b))))
    assert same("1", "1.0.0") and same("4r1", "4.1") and not same("1", "1.1")


def test_rounding_and_skeletons(spark):
    assert one(spark, X.round_half_up(F.lit(-2.5))) == -2
    assert one(spark, X.digit_skeleton(F.lit("a1.2 b34"))) == "a# b#"
    assert one(spark, X.clip(F.lit("abcdefgh"), 6)) == "abc..."
    assert one(spark, X.safe_name(F.lit("a/b:c d"))) == "a_b_c d"
    assert one(spark, X.squash(F.lit("The Title: 2"))) == "thetitle2"
