from pyspark.sql import functions as F

from onomast.operators.ranks import running


def test_running_sums_over_ranges(spark):
    rows = [(k % 7 if k % 11 else None, k, None if k % 5 == 0 else k) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, id long, w long").repartition(8)
    got = sorted(running(df, [F.col("g").desc_nulls_last(), F.col("id").asc()], ["w"]).collect(), key=lambda r: r["n_before"])
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    total = 0
    for n, (row, r) in enumerate(zip(want, got, strict=True)):
        assert (r["g"], r["id"], r["w"], r["n_before"], r["w_before"]) == (*row, n, total)
        total += row[2] or 0


def test_running_over_nothing(spark):
    assert running(spark.range(0), [F.col("id")], ["id"]).collect() == []
