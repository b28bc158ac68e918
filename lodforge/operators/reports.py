"""Reports over chunks and datasets: roll-ups, frames that must agree, densities, costs, choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = [f"{n}_{k}" for n in ("min", "max") for k in "xyz"]


def agreed(column: str, otherwise: Column | None = None) -> Column:
    """The value that all rows share, else ``otherwise`` (null if not given); a null beside a value is a difference."""
    same = (F.count_distinct(column) <= 1) & ((F.count(column) == 0) | (F.count(column) == F.count("*")))
    return F.when(same, F.max(column)).otherwise(otherwise if otherwise is not None else F.lit(None))


def chunk_rollup(reports: DataFrame) -> DataFrame:
    """One row over chunk reports (chunk_id, bounds, source_points, emitted_points, tiles, has_rgb, step, crs, error_before, error_after).

    Bounds are united, counts summed, flags true if any is; ``step`` and ``crs`` stay only where all agree, else null and
    "mixed". No reports: counts are null.
    """
    bounds = [(F.min if s.startswith("min") else F.max)(s).alias(s) for s in SIDES]
    return reports.agg(
        F.count("*").alias("chunks"), *bounds, F.sum("source_points").alias("source_points"), F.sum("emitted_points").alias("emitted_points"), F.sum("tiles").alias("tiles"),
        F.coalesce(F.bool_or("has_rgb"), F.lit(False)).alias("has_rgb"), agreed("step").alias("step"), agreed("crs", F.lit("mixed")).alias("crs"), F.max("error_before").alias("error_before"), F.max("error_after").alias("error_after"),
    )


def check_frames(reports: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Each report (chunk_id, mode, origin, transform) with ``drift``, ``agrees`` and ``mixed``.

    ``drift`` is the largest difference of any number of a globe report's origin or transform from those of the first globe
    report by name; null for local ones. A globe report without numbers, or with another count of them, doesn't agree. ``mixed``
    tells whether local and globe reports meet.
    """
    numbers = F.concat("origin", "transform")
    globe = F.col("mode") == "globe"
    first = reports.agg(F.min_by(F.when(globe, numbers), F.when(globe, F.col("chunk_id"))).alias("_first"), (F.count_distinct("mode") > 1).alias("mixed"))  # one row
    both = reports.crossJoin(F.broadcast(first))
    gaps = F.transform(F.arrays_zip(numbers.alias("a"), F.col("_first").alias("b")), lambda v: F.abs(v["a"] - v["b"]))
    same = (F.size(numbers) == F.size("_first")) & F.forall(gaps, lambda v: v.isNotNull() & (v <= tolerance))
    return both.select("chunk_id", F.when(globe, F.array_max(gaps)).alias("drift"), F.when(globe, F.coalesce(same, F.lit(False))).otherwise(F.lit(True)).alias("agrees"), "mixed")


def density_ratio(source: Column, emitted: Column) -> Column:
    """Emitted over source points; null where the source has none."""
    return F.try_divide(emitted, source)


def dataset_report(datasets: DataFrame, measured: DataFrame, reported: DataFrame, key: str = "dataset") -> DataFrame:
    """One row a dataset: a figure of its report, if it has one, else the measured one, else that of the dataset itself.

    Other columns of the three tables are looked up by name. Measured and reported have one row a dataset.
    """
    figures = [c for c in datasets.columns if c != key] + [c for t in (measured, reported) for c in t.columns if c != key]
    figures = list(dict.fromkeys(figures))
    named = [(t.select(key, *[F.col(c).alias(f"_{k}_{c}") for c in t.columns if c != key]), t.columns, k) for k, t in enumerate((datasets, measured, reported))]
    joined = named[0][0].join(named[1][0], key, "left").join(named[2][0], key, "left")
    best = lambda c: F.coalesce(*[F.col(f"_{k}_{c}") for _, own, k in reversed(named) if c in own])
    return joined.select(key, *[best(c).alias(c) for c in figures])


def tiered_cost(usage: DataFrame, tiers: DataFrame, amount: str = "amount", keys=("month",)) -> DataFrame:
    """``usage`` by ``keys`` and ``kind`` with ``cost``: each tier (kind, low, high or null, price) prices its part of the amount.

    Tiers are few; usage of a kind without tiers costs nothing. A null amount counts as zero.
    """
    part = F.greatest(F.least(F.coalesce(F.col(amount), F.lit(0)), F.coalesce("high", F.lit(float("inf")))) - F.col("low"), F.lit(0.0)) * F.col("price")
    joined = usage.join(F.broadcast(tiers), "kind", "left")
    return joined.groupBy(*keys, "kind").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("cost"))


def pack_reasons(m: DataFrame) -> DataFrame:
    """Pack candidates (area_id, level, tiles, mean_bytes, largest_bytes, density, error_before, error_after, failed) with ``reasons`` and ``status``."""

    def rule(name: str, column: str, low: float | None, high: float | None):
        c = F.col(column)
        below = [F.when(c < low, F.lit(f"{name}_low"))] if low is not None else []
        return F.when(c.isNull(), F.lit(f"{name}_missing")).otherwise(F.coalesce(*below, F.when(c > high, F.lit(f"{name}_high")), F.lit(None).cast("string")))

    drop = F.when(F.col("error_before").isNull() | F.col("error_after").isNull(), F.lit("error_missing")).when(F.col("error_after") >= F.col("error_before"), F.lit("error_not_less"))
    rules = [rule("tiles", "tiles", 200, 1000), rule("mean_bytes", "mean_bytes", 102400, 512000), rule("largest_bytes", "largest_bytes", None, 5242880), rule("density", "density", 0.095, 0.105), drop, F.when(F.col("failed"), F.lit("failed"))]
    named = m.withColumn("reasons", F.array_compact(F.array(*rules)))
    return named.withColumn("status", F.when(F.col("failed"), "failed").when(F.size("reasons") == 0, "accepted").otherwise("needsReview"))


#: Reasons after which the next level is tried.
RETRY = ("tiles_low", "tiles_high", "mean_bytes_low", "mean_bytes_high", "largest_bytes_high", "failed")


def choose_pack_level(candidates: DataFrame) -> DataFrame:
    """``area_id``, ``level``, ``status`` chosen from candidates with ``place`` (their order), ``status`` and ``reasons``.

    The first candidate that needs no retry ends the search. An accepted one later than the first is ``fallbackAccepted``; if
    all ask for a retry, the last one stands as it is.
    """
    ends = (F.col("status") == "accepted") | ~F.arrays_overlap("reasons", F.array(*map(F.lit, RETRY)))
    w = Window.partitionBy("area_id")
    picked = candidates.withColumn("_end", F.coalesce(F.min(F.when(ends, F.col("place"))).over(w), F.max("place").over(w))).withColumn("_first", F.min("place").over(w)).where(F.col("place") == F.col("_end"))
    fallback = (F.col("status") == "accepted") & (F.col("place") > F.col("_first"))
    return picked.select("area_id", "level", F.when(fallback, "fallbackAccepted").otherwise(F.col("status")).alias("status"))


def tile_warnings(tiles: DataFrame, root: DataFrame, most_points: int = 150_000, most_bytes: int = 5 << 20, most_tiles: int = 5000, widest: float = 1e6) -> DataFrame:
    """``rule``, ``found`` for each rule over tiles (n, bytes and bounds) and the root's bounds (one row): how many tiles break it."""
    outside = F.lit(False)
    for s in SIDES:
        outside = outside | (F.col(s) < F.col(f"root_{s}") if s.startswith("min") else F.col(s) > F.col(f"root_{s}"))
    sides = [F.col(f"root_max_{k}") - F.col(f"root_min_{k}") for k in "xyz"]
    both = tiles.crossJoin(F.broadcast(root.select(*[F.col(s).alias(f"root_{s}") for s in SIDES])))  # one row
    counts = both.agg(F.count_if(F.col("n") > most_points).alias("points"), F.count_if(F.col("bytes") > most_bytes).alias("bytes"), F.greatest(F.count("*") - most_tiles, F.lit(0)).alias("tiles"), F.count_if(F.greatest(*sides) > widest).alias("root_side"), F.count_if(outside).alias("outside_root"))
    return counts.unpivot([], ["points", "bytes", "tiles", "root_side", "outside_root"], "rule", "found")
