"""Areas of a dataset: manifest, wrappers, detection from view samples, datasets of a mode, document chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodforge.functions import geometry as g

SIDES = [f"{n}_{k}" for n in ("min", "max") for k in "xyz"]
MODES = ("explore", "detail", "context")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``area_id``: area-001 onwards in the order of ``key``, one row a value of it; ties keep one number each in any order."""
    return rows.withColumn("area_id", F.concat(F.lit("area-"), F.lpad(F.row_number().over(Window.orderBy(key)).cast("string"), 3, "0")))


def area_manifest(reports: DataFrame, datasets: DataFrame) -> DataFrame:
    """One numbered area a chunk report, with its bounds in the frame that fits, its points and the build status of each mode.

    ``reports``: chunk_id, mode, source bounds, ``enu_`` bounds (null if unknown), source_points, emitted_points. ``datasets``:
    dataset (``<area_id>/<mode>``), status. The local frame holds only if every report is a globe one; a bound it lacks comes
    from the source. Areas are few, one a chunk, so one task numbers them.
    """
    globe = F.bool_and(F.col("mode") == "globe").over(Window.partitionBy(F.lit(0)))
    rows = numbered(reports.withColumn("globe", F.coalesce(globe, F.lit(False))), "chunk_id")
    bounds = [F.when(F.col("globe"), F.coalesce(f"enu_{s}", s)).otherwise(F.col(s)).alias(s) for s in SIDES]
    rows = rows.select("area_id", "chunk_id", "globe", *bounds, F.coalesce(F.nullif("source_points", F.lit(0)), "emitted_points").alias("points"))
    named = rows.select("*", F.explode(F.array(*map(F.lit, MODES))).alias("_mode"))
    joined = named.join(datasets, F.concat_ws("/", "area_id", "_mode") == F.col("dataset"), "left")
    statuses = [F.coalesce(F.max(F.when(F.col("_mode") == m, F.col("status"))), F.lit("not_built")).alias(m) for m in MODES]
    return joined.groupBy("area_id", "chunk_id", "globe", *SIDES, "points").agg(*statuses)


def overview_excluding(areas: DataFrame, children: DataFrame) -> DataFrame:
    """For each area how many overview children stay without its own chunk and with how many points; ``valid`` if exactly one went.

    ``children``: chunk_id, points. No pairs are made: an area's figures are the totals less those of its own chunk's children.
    """
    totals = children.agg(F.count("*").alias("all_children"), F.coalesce(F.sum("points"), F.lit(0)).alias("all_points"))  # one row
    own = children.groupBy("chunk_id").agg(F.count("*").alias("removed"), F.sum("points").alias("own_points"))
    rows = areas.select("area_id", "chunk_id").join(own, "chunk_id", "left").fillna(0, ["removed", "own_points"]).crossJoin(F.broadcast(totals))
    left = F.greatest(F.col("all_points") - F.col("own_points"), F.lit(0))
    return rows.select("area_id", "chunk_id", "removed", (F.col("all_children") - F.col("removed")).alias("children"), left.alias("points"), (F.col("removed") == 1).alias("valid"))


def area_detail(areas: DataFrame, reports: DataFrame) -> DataFrame:
    """Each area with its full-density chunk's uri, points, box and error (the diagonal where the report has none); areas without report go."""
    rows = areas.select("area_id", "chunk_id").join(reports, "chunk_id")
    low, high = ([F.col(f"{n}_{k}") for k in "xyz"] for n in ("min", "max"))
    diagonal = g.diagonal(*[h - l for l, h in zip(low, high, strict=True)])
    return rows.select("area_id", "chunk_id", F.concat(F.lit("chunks/"), "chunk_id", F.lit("/tileset.json")).alias("uri"), F.coalesce("source_points", "emitted_points").alias("points"), g.box(tuple(low), tuple(high)).alias("box"), F.coalesce("error", diagonal).alias("error"))


#: Most areas that are broadcast to meet the samples; more of them meet in squares of the plane.
FEW_AREAS = 10_000


def matches(samples: DataFrame, areas: DataFrame, slack: float = 0.01) -> DataFrame:
    """Samples with the areas whose square holds them, up to ``slack``: sample columns, ``area_id``, ``inside_z``, ``footprint``.

    Few areas are broadcast. Many are cut by a grid as wide as the widest, so that an area lies in at most four squares and a
    sample meets only those of its own.
    """
    a = areas.select("area_id", *[F.col(s).alias(f"_{s}") for s in SIDES]).where(" and ".join(f"_{s} is not null and abs(_{s}) < double('Infinity')" for s in SIDES))
    held = a.agg(F.count("*"), F.max(F.greatest(*[F.col(f"_max_{k}") - F.col(f"_min_{k}") for k in "xy"]))).first()
    inside = lambda k: F.col(k).between(F.col(f"_min_{k}") - slack, F.col(f"_max_{k}") + slack)
    if held[0] <= FEW_AREAS:
        met = samples.join(F.broadcast(a), inside("x") & inside("y"))
    else:
        side = (held[1] or 0.0) + 2 * slack + 1e-9
        square = lambda c: F.floor(c / side)
        spread = a
        for k in "xy":
            spread = spread.withColumn(f"_s{k}", F.explode(F.sequence(square(F.col(f"_min_{k}") - slack), square(F.col(f"_max_{k}") + slack))))
        own = samples.withColumns({f"_q{k}": square(F.col(k)) for k in "xy"})
        met = own.join(spread, (F.col("_qx") == F.col("_sx")) & (F.col("_qy") == F.col("_sy")) & inside("x") & inside("y"))
    foot = F.greatest(F.col("_max_x") - F.col("_min_x"), F.lit(0.0)) * F.greatest(F.col("_max_y") - F.col("_min_y"), F.lit(0.0))
    return met.select(*samples.columns, "area_id", inside("z").alias("inside_z"), foot.alias("footprint"))


def detect_area(samples: DataFrame, areas: DataFrame, slack: float = 0.01) -> DataFrame:
    """``view_id``, ``samples``, ``matched`` (samples in any area), ``area_id`` and ``score`` of the best area, ``reason`` for every view.

    A sample adds its weight to each area that holds it, 1.05 times so if its height fits too. The best has the largest score,
    then the largest weight of a sample, then the smallest footprint, then the first id.
    """
    met = matches(samples, areas, slack)
    score = F.round(F.sum(F.col("weight") * F.when(F.col("inside_z"), 1.05).otherwise(1.0)), 9)
    scored = met.groupBy("view_id", "area_id").agg(score.alias("score"), F.max("weight").alias("most"), F.min("footprint").alias("footprint"))
    best = scored.groupBy("view_id").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("most")).alias("m"), "footprint", "area_id")).alias("b"))
    found = met.groupBy("view_id").agg(F.count_distinct("sample_id").alias("matched"))
    every = samples.groupBy("view_id").agg(F.count("*").alias("samples"))
    rows = every.join(best, "view_id", "left").join(found, "view_id", "left")
    return rows.select("view_id", "samples", F.coalesce("matched", F.lit(0)).alias("matched"), F.col("b.area_id").alias("area_id"), (-F.col("b.s")).alias("score"), F.when(F.col("b").isNull(), "no_area_match").otherwise("matched").alias("reason"))


def resolve_dataset(asked: DataFrame, manifest: DataFrame, dataset: str) -> DataFrame:
    """``asked`` (mode, area_id) with ``resolved``, ``status``, ``label``: the overview's dataset, or that of the area and mode; a name by rule if none is known."""
    rows = asked.join(manifest.select("area_id", *[F.col(m).alias(f"_{m}") for m in MODES], F.lit(1).alias("_known")), "area_id", "left")
    mode = F.col("mode")
    status = F.when(mode == "overview", "ready").otherwise(F.coalesce(F.when(mode == "explore", F.col("_explore")).otherwise(F.col("_detail")), F.lit("not_built")))
    area = F.coalesce("area_id", F.lit("area-001"))
    tail = F.when(mode == "explore", "p10").otherwise("full")
    name = F.when(mode == "overview", F.lit(f"{dataset}-overview")).when(F.col("_known") == 1, F.concat(F.lit(f"{dataset}/"), area, F.lit("/"), mode)).otherwise(F.concat(F.lit(f"{dataset}-"), area, F.lit("-"), tail))
    label = F.when(F.col("status") == "ready", "ready").when(F.col("status") == "building", "Building").when(F.col("status") == "failed", "Failed").when(mode == "detail", "Build required").when(mode == "explore", "Not built yet").otherwise(F.col("status"))
    return rows.withColumn("resolved", name).withColumn("status", status).withColumn("label", label).select(*asked.columns, "resolved", "status", "label")


def lod_chain(overview: DataFrame, explore: DataFrame, detail: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Per area the chain overview, explore, detail (each: area_id, uri, bounds, error), whether each hop holds the next one's box, and errors raised to the largest below."""
    side = lambda df, name: df.select("area_id", F.col("uri").alias(f"{name}_uri"), F.col("error").alias(f"{name}_e"), *[F.col(s).alias(f"{name}_{s}") for s in SIDES])
    rows = side(overview, "overview").join(side(explore, "explore"), "area_id").join(side(detail, "detail"), "area_id")
    of = lambda name: tuple(F.col(f"{name}_{s}") for s in SIDES)
    explore_error = F.greatest("explore_e", "detail_e")
    return rows.select(
        "area_id", "overview_uri", "explore_uri", "detail_uri", g.contains(of("overview"), of("explore"), tolerance).alias("holds_explore"), g.contains(of("explore"), of("detail"), tolerance).alias("holds_detail"),
        F.greatest("overview_e", explore_error).alias("overview_error"), explore_error.alias("explore_error"), F.col("detail_e").alias("detail_error"),
    )
