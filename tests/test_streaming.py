from collatrix.streaming import arrivals as A


def test_versions_meet_the_one_before(spark, tmp_path):
    put = lambda name, rows: spark.createDataFrame(rows, A.VERSIONS).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    run = lambda: A.changes_of_arrivals(A.read_versions(spark, f"{tmp_path}/in/*"), f"{tmp_path}/kept", f"{tmp_path}/changes", f"{tmp_path}/cp").awaitTermination()
    put("1", [("s", 1, 10, "the amber lamp is lit"), ("t", 1, 20, "other words")])
    run()
    put("2", [("s", 2, 11, "the cobalt lamp is lit"), ("s", 3, 12, "the cobalt lamp is out")])
    run()
    got = {(r.a, r.b, r.a_tokens, r.b_tokens) for r in spark.read.parquet(f"{tmp_path}/changes").collect()}
    assert got == {(10, 11, "amber", "cobalt"), (11, 12, "lit", "out")}
