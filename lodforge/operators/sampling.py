"""Quotas over microcells and the points that represent them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quota_allocation(occupancy: DataFrame, quota: int, node=("node",)) -> DataFrame:
    """``occupancy`` (node columns, cell, cnt) with ``alloc``: largest remainders, one each where possible, never over the count."""
    w = Window.partitionBy(*node)
    rows = occupancy.withColumn("tot", F.sum("cnt").over(w)).withColumn("n", F.count("*").over(w)).withColumn("q", F.greatest(F.lit(0), F.least(F.lit(quota), F.col("tot"))))
    rows = rows.withColumn("top", F.row_number().over(w.orderBy(F.desc("cnt"), "cell")))
    share = (F.col("q") - F.col("n")) * F.col("cnt") / F.col("tot")
    rows = rows.withColumn("t", share.cast("double")).withColumn("f", F.greatest(F.lit(0), F.least(F.floor("t"), F.col("cnt") - 1)))
    rows = rows.withColumn("rest", F.col("q") - F.col("n") - F.sum("f").over(w)).withColumn("can", (F.col("f") + 1 < F.col("cnt")).cast("int"))
    order = w.orderBy(F.desc(F.col("t") - F.col("f")), "cell")
    rows = rows.withColumn("b", ((F.col("can") == 1) & (F.sum("can").over(order.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("rest"))).cast("int"))
    rows = rows.withColumn("rest2", F.col("rest") - F.sum("b").over(w)).withColumn("spare", F.col("cnt") - 1 - F.col("f") - F.col("b"))
    before = F.coalesce(F.sum("spare").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("sweep", F.greatest(F.lit(0), F.least(F.col("spare"), F.col("rest2") - before)))
    alloc = F.when(F.col("q") <= 0, 0).when(F.col("q") <= F.col("n"), (F.col("top") <= F.col("q")).cast("int")).otherwise(1 + F.col("f") + F.col("b") + F.col("sweep"))
    return rows.select(*node, "cell", "cnt", alloc.cast("long").alias("alloc"))
