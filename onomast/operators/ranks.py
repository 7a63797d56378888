"""Row numbers and running sums in one global order, without a window that has all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.sources.store import written


def running(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), number: str = "n_before") -> DataFrame:
    """Adds `number`, the rows before a row in the stated order, and `<s>_before`, the sum of each long column s over them.

    Rows are dealt out by ranges of the order and written, so that a range's place is fixed; one number a range and sum, as many as
    there are ranges, goes through the driver and becomes the offset of the range's own windows. An order by a unique key splits
    ties over several ranges. Null summands count as 0.
    """
    part = "__part"
    rows = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    counted = {number: F.lit(1), **{f"{s}_before": F.coalesce(F.col(s), F.lit(0)) for s in sums}}
    found = rows.groupBy(part).agg(*[F.sum(c).cast("bigint").alias(name) for name, c in counted.items()]).collect()
    totals = {r[part]: r for r in found}
    window = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    for name, c in counted.items():
        offsets, total = [], 0
        for k in range(max(totals, default=-1) + 1):
            offsets.append(total)
            total += totals[k][name] if k in totals else 0
        start = F.element_at(F.lit(offsets).cast("array<bigint>"), F.col(part) + 1) if offsets else F.lit(0)
        out = out.withColumn(name, (start + F.coalesce(F.sum(c).over(window), F.lit(0))).cast("bigint"))
    return out.drop(part)
