from collatrix.operators import rounds as R

LINES = [(1, "v1", 10, "the quick brown"), (1, "v1", 11, "fox jumps over"), (1, "v1", 30, "a lazy dog"), (1, "v2", 10, "something else"), (1, "v2", 12, "quick brown fox"), (1, "v3", 50, "late words here")]


def frames(spark, probes):
    return (
        spark.createDataFrame(probes, "review_id int, probe int, round int, first int, last int, snippet string"),
        spark.createDataFrame(LINES, "review_id int, version string, num int, text string"),
    )


def test_evidence_and_sure_rounds(spark):
    probes, lines = frames(spark, [(1, 0, 0, 10, 10, "Brown fox"), (1, 1, 0, 29, 29, "lazy “dog”"), (1, 2, 2, 50, 51, "late words"), (1, 3, 3, 1, 1, "nowhere"), (1, 4, 3, 2, 2, "nothing"), (1, 5, 4, 1, 1, "no")])
    got = {(r.round, r.version): r.score for r in R.evidence(probes, lines).collect()}
    assert got == {(0, "v1"): 1.5, (0, "v2"): 0.5, (2, "v3"): 1.0}
    assert {(r.round, r.version) for r in R.sure_rounds(probes, lines).collect()} == {(0, "v1"), (2, "v3"), (3, None)}


def test_rounds_without_evidence_lie_between(spark):
    rounds = spark.createDataFrame([(1, k) for k in range(5)], "review_id int, round int")
    versions = spark.createDataFrame([(1, f"v{k}", k) for k in range(4)], "review_id int, version string, place int")
    sure = spark.createDataFrame([(1, 0, "v0"), (1, 3, "v2")], "review_id int, round int, version string")
    got = {r.round: r.version for r in R.assign_rounds(rounds, sure, versions).collect()}
    assert got == {0: "v0", 1: "v1", 2: None, 3: "v2", 4: "v3"}
    chosen = spark.createDataFrame([(1, 2, "v3"), (1, 0, None)], "review_id int, round int, version string")
    got = {r.round: r.version for r in R.assign_rounds(rounds, sure, versions, chosen).collect()}
    assert got == {0: None, 1: "v1", 2: "v3", 3: "v2", 4: "v3"}
