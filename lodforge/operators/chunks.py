"""Chunks of points: squares with and without overlap, pruning by bounds, thinning, merging, choice of chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import SLICE, running, sliced


def spatial_chunk(points: DataFrame, length: float = 500.0, origin: tuple[float, float] = (0.0, 0.0), buffer: float = 0.0) -> DataFrame:
    """``points`` with ``cx``, ``cy``, the square of side ``length`` they lie in, and ``is_buffer``.

    With a ``buffer`` a point within that distance of a neighbouring square is emitted there too, marked. Points with a null
    coordinate go. Columns of these names are replaced.
    """
    square = lambda k, o, shift=0.0: F.floor((F.col(k) + shift - o) / length).cast("int")
    rows = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if not buffer:
        return rows.withColumns({"cx": square("x", origin[0]), "cy": square("y", origin[1]), "is_buffer": F.lit(False)})
    for name, k, o in (("cx", "x", origin[0]), ("cy", "y", origin[1])):
        rows = rows.withColumn(name, F.explode(F.sequence(square(k, o, -buffer), square(k, o, buffer))))
    return rows.withColumn("is_buffer", (F.col("cx") != square("x", origin[0])) | (F.col("cy") != square("y", origin[1])))


def write_chunks(chunked: DataFrame, path: str, length: float = 500.0) -> None:
    """Writes squares as folders ``cx=…/cy=…``; rows are dealt by square and a hash part, so a crowded square is written by several tasks."""
    spread = chunked.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(4)))
    spread.repartition("cx", "cy", "_part").drop("_part").write.mode("overwrite").partitionBy("cx", "cy").parquet(path)


def chunk_stats(points: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key``, bounds and ``n`` of every chunk."""
    return points.groupBy(key).agg(*[f(k).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k in "xy"], F.count("*").alias("n"))


def prune(stats: DataFrame, boxes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks whose bounds meet any box (low_x, low_y, high_x, high_y), touching edges included. Boxes are few and broadcast."""
    b = F.broadcast(boxes)
    return stats.join(b, (stats["max_x"] >= b["low_x"]) & (stats["min_x"] <= b["high_x"]) & (stats["max_y"] >= b["low_y"]) & (stats["min_y"] <= b["high_y"]), "left_semi").select(key)


def curve_key(x: Column, y: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Interleaved bits of both coordinates on a grid of 2^16 steps a side over ``bounds`` (low x, low y, high x, high y): near points have near keys."""

    def spread(value: Column, low: float, high: float) -> Column:
        step = F.greatest(F.least(F.floor((value - low) / max(high - low, 1e-300) * 65536), F.lit(65535)), F.lit(0)).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            step = step.bitwiseOR(F.shiftleft(step, shift)).bitwiseAND(F.lit(mask))
        return step

    return spread(x, bounds[0], bounds[2]).bitwiseOR(F.shiftleft(spread(y, bounds[1], bounds[3]), 1))


def write_along_curve(points: DataFrame, path: str, rows: int = 1_000_000) -> DataFrame:
    """Writes ``points`` along a space-filling curve, at most ``rows`` a file, and returns ``file``, bounds and ``n`` of every file, written beside.

    Points without both coordinates come first, in files of which bounds may be null. Each file covers a small area, and so does
    each row group in it. No points: no files.
    """
    spark = points.sparkSession
    low = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    keyed = points.withColumn("_key", curve_key(F.col("x"), F.col("y"), tuple(v if v is not None else 0.0 for v in low)))
    keyed.repartitionByRange("_key").sortWithinPartitions("_key").drop("_key").write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(f"{path}/points")
    held = spark.read.schema(points.schema).parquet(f"{path}/points").withColumn("file", F.col("_metadata.file_path"))
    chunk_stats(held, "file").write.mode("overwrite").parquet(f"{path}/bounds")
    return spark.read.parquet(f"{path}/bounds")


def read_box(spark: SparkSession, path: str, low: tuple[float, float], high: tuple[float, float]) -> tuple[DataFrame, int]:
    """Points of ``write_along_curve`` in a box, edges included, and how many files are read: those whose bounds meet it.

    Their names pass through the driver, as those of any files read do; the box goes on as a filter to the files' row groups.
    """
    bounds = spark.read.parquet(f"{path}/bounds")
    boxes = spark.createDataFrame([(*low, *high)], "low_x double, low_y double, high_x double, high_y double")
    files = [r["file"] for r in prune(bounds, boxes, "file").collect()]
    schema = spark.read.parquet(f"{path}/points").schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.where(F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1])), len(files)


def decimate(points: DataFrame, step: int, node=("chunk_id",), order: str = "ordinal") -> DataFrame:
    """Every ``step``-th point of each node in ``order``: places 0, step, 2 step and so on. A node may hold any share of the points."""
    rows = running(sliced(points, list(node), [order]), list(node), [order], before=True, _s=("sum", F.lit(1)))
    return rows.where(F.col("_s") % step == 0).drop("_s", SLICE)


def consolidate(parts: list[DataFrame]) -> DataFrame:
    """All rows of all sources; a column that a source lacks is null there. One source at least."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def select_chunks(ledger: DataFrame, done: DataFrame, limit: int, key: str = "chunk_id") -> DataFrame:
    """The first ``limit`` chunks by name that aren't done."""
    return ledger.join(done.select(key).distinct(), key, "left_anti").orderBy(key).limit(limit)
