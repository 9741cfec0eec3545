from roadpulse.operators.ordering import dense_index


def test_dense_index_matches_sorted_rank(spark):
    vals = [(v,) for v in [7, 3, 3, 1000, -5, 42, 7, 8, 9, 10, 11, 12, 13] * 3]
    df = spark.createDataFrame(vals, "k long").repartition(5)
    got = {r["k"]: r["index"] for r in dense_index(df, "k", partitions=4).collect()}
    want = {k: i for i, k in enumerate(sorted({v[0] for v in vals}))}
    assert got == want
