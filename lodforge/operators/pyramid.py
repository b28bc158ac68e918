"""The fixed pyramid: nested samples over nested square cells, as rows of tiles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodforge.functions import geometry as g


@dataclass(frozen=True)
class Level:
    """``cell``: side in metres; ``step``: every how many ordinals a point is taken; ``error``: geometric error in metres."""

    cell: float
    step: int
    error: float


#: The five levels, and the four of older builds.
LEVELS = (Level(2000.0, 1000, 4000.0), Level(1000.0, 50, 1000.0), Level(500.0, 10, 500.0), Level(250.0, 2, 250.0), Level(50.0, 1, 0.0))
OLD_LEVELS = (Level(2000.0, 50, 2000.0), Level(500.0, 10, 500.0), Level(250.0, 2, 250.0), Level(50.0, 1, 0.0))


def pyramid_cells(points: DataFrame, origin: tuple[float, float], levels=LEVELS) -> DataFrame:
    """``lvl``, ``ix``, ``iy``, ``n`` (points of the level's sample, 0 possible), ``zmin``, ``zmax`` (of all points) of every occupied cell.

    ``points``: ordinal, x, y, z. Points are aggregated once, into leaf cells; every level comes from those. The leaf's side must
    divide every level's. Points with a null coordinate or ordinal take no part; no points: no rows.
    """
    leaf, last = levels[-1], len(levels) - 1
    key = [g.cell_index(F.col(a), o, leaf.cell).alias(f"i{a}") for a, o in zip("xy", origin, strict=True)]
    sound = points.where(F.col("ordinal").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    cells = sound.groupBy(*key).agg(*[F.count_if(F.col("ordinal") % v.step == 0).alias(f"n{k}") for k, v in enumerate(levels)], F.min("z").alias("zmin"), F.max("z").alias("zmax"))
    own = [F.struct(F.lit(k).alias("lvl"), *[F.floor(F.col(f"i{a}") / int(v.cell / leaf.cell)).cast("int").alias(f"i{a}") for a in "xy"], F.col(f"n{k}").alias("n")) for k, v in enumerate(levels)]
    every = cells.select(F.explode(F.array(*own)).alias("t"), "zmin", "zmax").select("t.*", "zmin", "zmax")
    coarse = every.where(F.col("lvl") < last).groupBy("lvl", "ix", "iy").agg(F.sum("n").alias("n"), F.min("zmin").alias("zmin"), F.max("zmax").alias("zmax"))
    return coarse.unionByName(every.where(F.col("lvl") == last))


def request_volumes(cells: DataFrame, origin: tuple[float, float], levels=LEVELS) -> DataFrame:
    """Leaf cells (``ix``, ``iy``) with ``request``, the request box they share with all leaves below the same parent cell."""
    last = len(levels) - 1
    ratio = int(levels[last - 1].cell / levels[last].cell)
    parents = cells.where(F.col("lvl") == last - 1).select(F.col("ix").alias("px"), F.col("iy").alias("py"), g.detail_volume(F.col("ix"), F.col("iy"), F.col("zmin"), F.col("zmax"), origin, levels[last - 1].cell).alias("request"))
    leaves = cells.where(F.col("lvl") == last).select("ix", "iy", *[F.floor(F.col(f"i{a}") / ratio).cast("int").alias(f"p{a}") for a in "xy"])
    return leaves.join(parents, ["px", "py"]).select("ix", "iy", "request")


def pyramid(points: DataFrame, origin: tuple[float, float], levels=LEVELS) -> DataFrame:
    """Tiles: ``lvl``, ``ix``, ``iy``, ``n``, ``bytes`` and ``uri`` (null without content), ``box``, ``error``, ``request`` (leaves only).

    Empty cells have no row; a cell with points of which none is in its level's sample is a tile without content.
    """
    cells = pyramid_cells(points, origin, levels)
    pick = lambda field: F.element_at(F.array(*[F.lit(float(getattr(v, field))) for v in levels]), F.col("lvl") + 1)
    side, has = pick("cell"), F.col("n") > 0
    low = [F.col(f"i{a}") * side + o for a, o in zip("xy", origin, strict=True)]
    box = g.box((*low, F.col("zmin")), (*[v + side for v in low], F.col("zmax")))
    uri = F.concat(F.lit("points/z"), F.col("lvl").cast("string"), F.lit("/"), g.tile_id(F.col("lvl"), F.col("ix"), F.col("iy")), F.lit(".pnts"))
    tiles = cells.select("lvl", "ix", "iy", "n", F.when(has, g.estimated_bytes(F.col("n"))).alias("bytes"), F.when(has, uri).alias("uri"), box.alias("box"), pick("error").alias("error"))
    volumes = request_volumes(cells, origin, levels).withColumn("lvl", F.lit(len(levels) - 1))
    return tiles.join(volumes, ["lvl", "ix", "iy"], "left")


def level_summary(cells: DataFrame) -> DataFrame:
    """``lvl``, ``tiles``, ``points``, ``bytes`` over cells with content (``n`` above 0)."""
    return cells.where("n > 0").groupBy("lvl").agg(F.count("*").alias("tiles"), F.sum("n").alias("points"), F.sum(g.estimated_bytes(F.col("n"))).alias("bytes"))


def upgrade_pyramid(old: DataFrame, points: DataFrame, origin: tuple[float, float], old_levels=OLD_LEVELS, levels=LEVELS) -> DataFrame:
    """Counts (``lvl``, ``ix``, ``iy``, ``n``) of the newer pyramid from the older one's.

    Older levels below the root move down a level as they are. Only the root's sample is read again: its points are split into
    the new second level's cells, and every ``levels[0].step``-th point makes the new root. Cells without points have no row.
    """
    kept = old.where("lvl > 0 and n > 0").select((F.col("lvl") + 1).alias("lvl"), "ix", "iy", "n")
    sampled = points.where(F.col("ordinal") % old_levels[0].step == 0)
    made = [
        sampled.where(F.col("ordinal") % v.step == 0).groupBy(F.lit(k).alias("lvl"), *[g.cell_index(F.col(a), o, v.cell).alias(f"i{a}") for a, o in zip("xy", origin, strict=True)]).agg(F.count("*").alias("n"))
        for k, v in enumerate(levels[:2])
    ]
    return reduce(DataFrame.unionByName, made, kept)


def profile_rows(levels, spark) -> DataFrame:
    """``lvl``, ``cell``, ``step``, ``error`` of a profile."""
    return spark.createDataFrame([(k, v.cell, v.step, v.error) for k, v in enumerate(levels)], "lvl int, cell double, step int, error double")


def profile_match(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of either profile that the other lacks, with ``side`` (found, expected); none if they match."""
    names = expected.columns
    return found.select(*names).exceptAll(expected).withColumn("side", F.lit("found")).unionByName(expected.exceptAll(found.select(*names)).withColumn("side", F.lit("expected")))


def check_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    """``id``, ``rows``, ``repeated``, ``malformed`` of every root-cell id that comes twice or isn't well-formed, null included."""
    counted = ids.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("rows"))
    malformed = ~F.coalesce(F.col("id").rlike(r"^z0_x-?\d{5,6}_y-?\d{5,6}$"), F.lit(False))
    return counted.select("id", "rows", (F.col("rows") > 1).alias("repeated"), malformed.alias("malformed")).where("repeated or malformed")


def check_profiles(profiles: DataFrame) -> DataFrame:
    """``id``, ``problem`` of every profile (id, least, target, leaf, hard, depth, grid, scale) whose scalars contradict each other or are missing.

    The limits must rise from a positive ``least`` to ``hard``; depth and grid are at least 1, the scale is finite and positive.
    """
    c, unless = F.col, lambda sound, text: F.when(~F.coalesce(sound, F.lit(False)), text)
    order = ("least", "target", "leaf", "hard")
    rules = [unless(c("least") > 0, "least must be positive"), *[unless(c(a) < c(b), f"{a} must be below {b}") for a, b in zip(order, order[1:], strict=False)]]
    rules += [unless(c(n) >= 1, f"{n} must be at least 1") for n in ("depth", "grid")]
    rules.append(unless((c("scale") > 0) & (c("scale") < float("inf")) & ~F.isnan("scale"), "scale must be finite and positive"))
    return profiles.select("id", F.concat_ws("; ", *rules).alias("problem")).where("problem <> ''")
