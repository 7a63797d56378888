"""Slow steps run in many tasks, and wide rows stay where they are."""

from pyspark.sql import functions as F

from onomast import corpus
from onomast.sources.segments import Segments


def test_names_are_analysed_in_many_tasks_of_one_row_group(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("p_partkey"), F.lit("red ring").alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = corpus.parts(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= min(4, spark.sparkContext.defaultParallelism)
    assert made.count() == 3000


def test_live_rows_meet_tombstones_without_a_shuffle(spark, tmp_path):
    out = Segments(spark, str(tmp_path), "id", ("body__text",))
    out.add(spark.range(100_000).select("id", F.lit("a b").alias("body__text")))
    out.commit()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out.delete(spark.range(0, 200_000, 3))
        out.commit()
        live = out.rows()
        plan = live._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        assert [r["id"] for r in live.orderBy("id").collect()] == [i for i in range(100_000) if i % 3]
        assert out.state.docs == 66_666 and out.frequencies("body__text", ["a", "c"]) == (66_666, {"a": 66_666, "c": 0})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
