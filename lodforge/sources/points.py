"""Survey points and viewing telemetry as DataFrames derived from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodforge.operators.work import once, written

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
#: Bits of a row's place inside its partition in ``monotonically_increasing_id``.
_PLACE = 33


def _ranged(rows: DataFrame, keys) -> DataFrame:
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())


def _offsets(placed: DataFrame) -> DataFrame:
    """First ordinal of each partition: one row a partition."""
    counts = placed.groupBy(F.shiftright("_m", _PLACE).alias("_b")).agg(F.count("*").alias("_n"))
    return counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_o"))


def _numbered(placed: DataFrame, offsets: DataFrame) -> DataFrame:
    part, place = F.shiftright("_m", _PLACE), F.col("_m").bitwiseAND(F.lit((1 << _PLACE) - 1))
    return placed.withColumn("_b", part).join(F.broadcast(offsets), "_b").withColumn("ordinal", (F.col("_o") + place).cast("long")).drop("_b", "_m", "_o")


def with_ordinal(rows: DataFrame, keys=KEY) -> DataFrame:
    """``rows`` with ``ordinal``: gapless from 0 in key order, nulls first; rows equal in all keys get their places in any order.

    Rows are dealt to key ranges, sorted there and written with their place, so ordinals never change afterwards. What one task
    sums up is one count a partition. No rows: no ordinals. A column of that name is replaced.
    """
    placed = written(_ranged(rows, keys), "ranged")
    return _numbered(placed, _offsets(placed))


def _shaped(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        *more, (F.col("l_extendedprice") * 8 / 100 - 2600).alias("x"), ((F.col("l_suppkey") % 100) * 37.5 + F.col("l_quantity") * 20 - 1500).cast("double").alias("y"),
        (F.col("l_discount") * 500 + 0.0).cast("double").alias("z"), (F.col("l_partkey") * 32 % 65536).alias("red"), (F.col("l_orderkey") * 8 % 65536).alias("green"), (F.col("l_linenumber") * 9000 % 65536).alias("blue"),
        F.concat(F.lit("chunk-"), (F.col("l_partkey") % 8).cast("string")).alias("chunk_id"),
    )


def plain_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, red, green, blue, chunk_id: for all that needs no ordinals, one scan and no shuffle."""
    return _shaped(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def points(spark: SparkSession, sf_dir: str, fresh: bool = False) -> DataFrame:
    """ordinal and the columns of ``plain_points``; places are written once a session unless ``fresh``, the rest is worked out from them at each read."""
    ranged = lambda: _ranged(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*KEY, "l_quantity", "l_discount"), KEY).drop("l_shipdate")
    placed = written(ranged(), "ranged") if fresh else once(spark, ("ranged", sf_dir), ranged)
    offsets = _offsets(placed) if fresh else once(spark, ("offsets", sf_dir), lambda: _offsets(placed))
    return _shaped(_numbered(placed, offsets), "ordinal")


def read_points(parts: list[DataFrame], names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points of all chunk sources in the order of their names, with ``chunk_id``, and one row of what holds for the whole dataset.

    A source has x, y, z, maybe red, green and blue, and maybe ``crs``. Colours stay only if every source has all three. The
    row: ``n``, the bounds, ``has_rgb``, ``crs`` (the one they share; null if none is known) and ``one_crs``, false if sources
    differ, known and unknown counting as different. Sources without rows count for colours, not for the rest.
    """
    colours = {"red", "green", "blue"}
    has_rgb = bool(parts) and all(colours <= set(p.columns) for p in parts)
    kept = ["x", "y", "z", *(sorted(colours, key=("red", "green", "blue").index) if has_rgb else [])]
    ordered = sorted(zip(names, parts, strict=True), key=lambda pair: pair[0])
    whole = reduce(DataFrame.unionByName, [p.select(*kept, (F.col("crs") if "crs" in p.columns else F.lit(None)).cast("string").alias("crs"), F.lit(n).alias("chunk_id")) for n, p in ordered])
    bounds = [f(k).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k in "xyz"]
    meta = whole.agg(F.count("*").alias("n"), *bounds, F.lit(has_rgb).alias("has_rgb"), F.max("crs").alias("crs"), ((F.count_distinct("crs") + F.max(F.col("crs").isNull().cast("int"))) <= 1).alias("one_crs"))
    return whole, meta


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource requests: event_id, session, ts, uri, transfer, encoded, decoded."""
    number = lambda n: (F.col("event_id") % n).cast("string")
    tile = F.concat(F.lit("points/adaptive/z0_x000001_y000001/d"), number(7), F.lit("_q"), number(4), F.lit(".pnts"))
    size = lambda k: F.round(F.col("value") * k).cast("long")
    return _events(spark, sf_dir).where(F.col("event_type").isin("view", "purchase")).select(
        "event_id", F.col("user_id").alias("session"), "ts", F.when(F.col("event_id") % 7 == 0, F.lit("points/z0/z0_x000001_y000001.pnts")).otherwise(tile).alias("uri"),
        F.when(F.col("event_id") % 5 == 0, F.lit(0).cast("long")).otherwise(size(1000)).alias("transfer"), size(1000).alias("encoded"), size(3000).alias("decoded"),
    )


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "refining").when(F.col("event_type") == "signup", "travel").otherwise("ready")
    return _events(spark, sf_dir).where(F.col("event_type").isin("click", "signup", "error")).select("event_id", F.col("user_id").alias("session"), "ts", kind.alias("phase"))


def camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "moveEnd").when(F.col("event_type") == "signup", "moveStart").otherwise("settingChange")
    return _events(spark, sf_dir).where(F.col("event_type").isin("click", "signup", "error")).select("event_id", F.col("user_id").alias("session"), "ts", kind.alias("kind"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted view samples: sample_id, view_id, x, y, z, weight."""
    k = F.col("event_id")
    return _events(spark, sf_dir).select(k.alias("sample_id"), F.col("user_id").alias("view_id"), (F.col("value") * 20 - 2000).alias("x"), ((k % 97) * 45 - 1200).cast("double").alias("y"), ((k % 11) * 5).cast("double").alias("z"), F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.75).otherwise(0.55).alias("weight"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("value") * 8000000)
    return _events(spark, sf_dir).select("event_id", F.col("user_id").alias("session"), "ts", F.col("value").alias("frame_ms"), F.round(F.col("value") * 100000).cast("long").alias("selected_points"), memory.alias("memory_bytes"), (F.col("value") / 50).alias("ratio"))


def areas(points_: DataFrame) -> DataFrame:
    """One numbered area a chunk: bounds and point count."""
    bounds = points_.groupBy("chunk_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"], F.count("*").alias("point_count"))
    number = F.row_number().over(Window.orderBy("chunk_id"))
    return bounds.withColumn("area_id", F.concat(F.lit("area-"), F.lpad(number.cast("string"), 3, "0")))
