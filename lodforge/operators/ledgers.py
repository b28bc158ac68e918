"""Comparisons of inventories: drift between two ledgers, absent content, runs of empty frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_content(referenced: DataFrame, present: DataFrame, key: str = "uri") -> DataFrame:
    """References without content and how often each is made."""
    return referenced.groupBy(key).agg(F.count("*").alias("refs")).join(present.select(key).distinct(), key, "left_anti")


def zero_runs(frames: DataFrame) -> DataFrame:
    """``session``, ``longest``: the longest run of frames without selected points after the session's first content.

    Sessions that never show content don't appear. Frames are ordered by (ts, event_id).
    """
    w = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.withColumn("run", F.count_if(F.col("selected_points") > 0).over(w)).where("run > 0")
    return rows.groupBy("session", "run").agg(F.count_if(F.col("selected_points") <= 0).alias("n")).groupBy("session").agg(F.max("n").alias("longest"))
