"""Connected components by label propagation with pointer jumping, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm.common import written


def connected(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) - from edges (u, v) of longs.

    A round hands every node the least label around it and then that label's own label, so paths shorten by
    jumps. Labels are pre-aggregated by node; hubs meet them in joins that adaptive execution can split. Only a count of
    changed nodes reaches the driver.
    """
    both = written(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(around, labels["node"] == around["u"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = written(lower.join(own, "label").select("node", F.least("up", "label").alias("label"), (F.least("up", "label") < F.col("old")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
