"""The residual quadtree: every point belongs to one node, inner nodes keep representatives and hand the rest to quadrants."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodforge.functions import geometry as g

from .sampling import quota_allocation
from .work import discard, written

NODE = ("ix", "iy", "path")

#: Most rows of a table of nodes or quotas that is broadcast to the points.
FEW = 500_000


def few(table: DataFrame) -> DataFrame:
    """``table`` written, and marked for broadcast if it has at most ``FEW`` rows: points then stay where they are; else they are shuffled to it."""
    held = written(table, "few")
    return F.broadcast(held) if held.count() <= FEW else held


@dataclass(frozen=True)
class Profile:
    """``target``: points an inner node keeps; ``leaf``, ``hard``: most of a leaf, and of one at ``depth``; ``grid``: microcells a side;
    ``least``: points below which a leaf is underfilled; ``scale``: of the error. Values that contradict each other are an error."""

    target: int = 400
    leaf: int = 1000
    hard: int = 1500
    depth: int = 5
    grid: int = 8
    scale: float = 2.0
    least: int | None = None

    def __post_init__(self) -> None:
        problems = profile_problems(self.target, self.leaf, self.hard, self.depth, self.grid, self.scale, self.least)
        if problems:
            raise ValueError("; ".join(problems))


def profile_problems(target, leaf, hard, depth, grid, scale, least=None) -> list[str]:
    """What is wrong with a profile's scalars; nothing for a sound one."""
    named = {"target": target, "leaf": leaf, "hard": hard, "depth": depth, "grid": grid} | ({} if least is None else {"least": least})
    odd = [f"{n} is no whole number" for n, v in named.items() if isinstance(v, bool) or not isinstance(v, int)]
    if odd:
        return odd
    order = [*([("least", least)] if least is not None else []), ("target", target), ("leaf", leaf), ("hard", hard)]
    found = [f"{order[0][0]} must be positive"] * (order[0][1] <= 0)
    found += [f"{a} must be below {b}" for (a, u), (b, v) in zip(order, order[1:], strict=False) if not u < v]
    found += ["depth must be at least 1"] * (depth < 1) + ["grid must be at least 1"] * (grid < 1)
    return found + ["scale must be finite and positive"] * (isinstance(scale, bool) or not isinstance(scale, (int, float)) or not 0 < scale < float("inf"))


def hash_cuts(points: DataFrame, quota: DataFrame, node=NODE, spare: float = 6.0) -> DataFrame:
    """``node``, ``cell``, ``last``: the greatest (hi, lo, ordinal) among the ``alloc`` smallest of each microcell that has a quota; written.

    Of ``cnt`` evenly spread hashes the ``alloc`` smallest lie below about alloc / cnt of their range. Only points below that share and
    some to spare are ranked, a number that depends on the quota and not on the cell's points. Where that finds too few, all cells are
    taken again with more to spare, at last with all points, so the result doesn't rest on how hashes are spread.
    """
    held = few(quota.where("alloc > 0").select(*node, "cell", "alloc", "cnt"))
    rank = F.row_number().over(Window.partitionBy(*node, "cell").orderBy("hi", "lo", "ordinal"))
    while True:
        share = F.least(F.lit(1.0), (F.col("alloc") + spare * F.sqrt("alloc") + 2 * spare) / F.col("cnt"))
        near = points.select(*node, "cell", "hi", "lo", "ordinal").join(held, [*node, "cell"]).where(F.col("hi") < F.ceil(share * (1 << 32)))
        kept = near.withColumn("_rank", rank).where(F.col("_rank") <= F.col("alloc"))
        cuts = written(kept.groupBy(*node, "cell").agg(F.max("_rank").alias("found"), F.max(F.struct("hi", "lo", "ordinal")).alias("last")), "cuts")
        short = held.join(cuts, [*node, "cell"], "left").where(F.coalesce("found", F.lit(0)) < F.least("alloc", "cnt"))
        if short.isEmpty():
            return cuts.drop("found")
        spare *= 16


def representatives(points: DataFrame, quota: DataFrame, node=NODE) -> DataFrame:
    """``points`` (node, cell, hi, lo, ordinal) with ``own``: true for the ``alloc`` smallest hashes of each microcell.

    ``quota`` comes from ``quota_allocation`` over all of the points. A cell without quota owns none. Points aren't sorted: they are
    compared with their cell's cut.
    """
    rows = points.join(few(hash_cuts(points, quota, node)), [*node, "cell"], "left")
    return rows.withColumn("own", F.coalesce(F.struct("hi", "lo", "ordinal") <= F.col("last"), F.lit(False))).drop("last")


def _kind(depth: int, profile: Profile, count: str = "input"):
    inner = F.lit("internal") if depth < profile.depth else F.when(F.col(count) <= profile.hard, "max-depth-leaf").otherwise("overflow")
    return F.when(F.col(count) <= profile.leaf, "leaf").otherwise(inner)


def _path(depth: int):
    """A square's path: a digit a level, east and twice north."""
    bit = lambda k, level: F.shiftright(k, level).bitwiseAND(F.lit(1))
    return F.concat(F.lit(""), *[(bit("east", k) + 2 * bit("north", k)).cast("string") for k in range(depth - 1, -1, -1)])


def _square(depth: int, profile: Profile) -> list:
    """A node of one depth by numbers: its root cell and its column and row of that depth's squares in it."""
    return ["ix", "iy", *[F.shiftright(k, profile.depth - depth).alias(n) for k, n in (("east", "u"), ("north", "v"))]]


def _packing(profile: Profile) -> dict[str, list[tuple[str, int, int]]]:
    """Long columns that tell a spot of a root cell: the squares and the microcells of all depths it lies in, as (name, first bit, bits)."""
    widths = {"east": profile.depth, "north": profile.depth} | {f"cell{d}": (profile.grid**2 - 1).bit_length() or 1 for d in range(profile.depth)}
    longs, at = [[]], 0
    for name, bits in widths.items():
        if at + bits > 62:
            longs, at = [*longs, []], 0
        longs[-1].append((name, at, bits))
        at += bits
    return {f"spot{k}": fields for k, fields in enumerate(longs)}


def _spots(x: np.ndarray, y: np.ndarray, ix: np.ndarray, iy: np.ndarray, profile: Profile, origin: tuple[float, float]) -> dict[str, np.ndarray]:
    """The columns of ``_packing``, by the same arithmetic in double precision as ``geometry.microcell``."""
    found = {}
    for name, v, k, o in (("east", x, ix, origin[0]), ("north", y, iy, origin[1])):
        low, turns = k * g.CELL + o, np.zeros(len(v), np.int64)
        for depth in range(profile.depth):  # a bit a level, from the first one down, of the half a point lies in
            size = g.CELL / 2**depth
            at = np.clip(np.nan_to_num((v - low) / size * profile.grid), 0, profile.grid - 1).astype(np.int64)
            found[f"cell{depth}"] = found.get(f"cell{depth}", 0) + at * (1 if name == "east" else profile.grid)
            beyond = v >= low + size / 2
            low, turns = low + beyond * (size / 2), turns * 2 + beyond
        found[name] = turns
    return {k: reduce(np.bitwise_or, [found[n] << at for n, at, _ in fields]) for k, fields in _packing(profile).items()}


def _spotted(points: DataFrame, profile: Profile, origin: tuple[float, float]) -> DataFrame:
    """``points`` with the columns of ``_packing``, worked out over columns of a batch, as one expression of that length would not be compiled."""
    names = [*_packing(profile)]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def spot(x: pd.Series, y: pd.Series, ix: pd.Series, iy: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_spots(*[v.to_numpy(np.float64) for v in (x, y, ix, iy)], profile, origin))

    rows = points.where("ix is not null and iy is not null").withColumn("_spot", spot(*[F.col(k).cast("double") for k in ("x", "y", "ix", "iy")]))
    return rows.select(*points.columns, *[F.col(f"_spot.{n}").alias(n) for n in names])


def _shares(spots: DataFrame, profile: Profile, spare: float) -> DataFrame:
    """``spots`` with ``limit0``…: upper halves of hashes below which a microcell's cut of that depth lies if hashes are spread evenly, with some to spare; 0 where no node can be inner."""
    sums = {}
    for depth in range(profile.depth):
        node = _square(depth, profile)
        sums |= {f"_n{depth}": F.sum("cnt").over(Window.partitionBy(*node)), f"_c{depth}": F.sum("cnt").over(Window.partitionBy(*node, f"cell{depth}"))}
    limits, taken = {}, F.lit(0.0)
    for depth in range(profile.depth):
        n, cnt = F.col(f"_n{depth}"), F.col(f"_c{depth}")
        taken = taken + F.when(n > profile.leaf, F.lit(float(profile.target)) / n + 1 / cnt).otherwise(0.0)
        share = F.least(F.lit(1.0), taken + (spare * F.sqrt(taken * cnt) + 2 * spare) / cnt)
        limits[f"limit{depth}"] = F.when(n > profile.leaf, F.ceil(share * (1 << 32))).otherwise(0)
    return spots.withColumns(sums).withColumns(limits).drop(*sums)


def _settled(turned: DataFrame, spots: DataFrame, profile: Profile, spare: float) -> DataFrame | None:
    """``spots`` with ``path``, the ``depth``, ``kind`` and ``input`` of the leaf that keeps what inner nodes leave, and ``cut0``…, ``input0``… of those; None if a cut wasn't found.

    What inner nodes own are the smallest hashes of a spot, however many levels take some. So only points below the greatest limit
    are looked at; which of the limits sufficed is seen by their number.
    """
    key = ["ix", "iy", *_packing(profile)]
    limits = [f"limit{d}" for d in range(profile.depth)]
    none = F.lit(None).cast("struct<hi:long,lo:long,ordinal:long>")
    now = _shares(spots, profile, spare).withColumns({"rest": F.col("cnt"), "done": none, "depth": F.lit(None).cast("int"), "kind": F.lit(None).cast("string"), "input": F.lit(None).cast("long")})
    now = written(now.withColumn("path", _path(profile.depth)).drop("cnt"), "spots")
    tall = now.select(*key, F.greatest(F.lit(0), F.lit(0), *limits).alias("_most")).where("_most > 0")
    near = written(turned.select(*key, "hi", "lo", "ordinal").join(few(tall), key).where("hi < _most").drop("_most"), "near")
    point = F.struct("hi", "lo", "ordinal")
    for depth in range(profile.depth + 1):
        last, node = depth == profile.depth, Window.partitionBy(*_square(depth, profile))
        square = dict(zip("uv", _square(depth, profile)[2:], strict=True))
        level = now.withColumns({**square, "_in": F.sum(F.when(F.col("depth").isNull(), F.col("rest"))).over(node)})
        level = level.withColumn("_kind", F.when(F.col("depth").isNull(), _kind(depth, profile, "_in")))
        leaf = F.col("_kind") != "internal"  # null where a leaf lies above
        if not last:
            cell = ["ix", "iy", "u", "v", f"cell{depth}"]
            open_ = level.where("_kind = 'internal' and rest > 0").groupBy(*cell).agg(F.sum("rest").alias("cnt"), F.min(f"limit{depth}").alias("_limit"))
            open_ = written(open_.withColumnRenamed(cell[-1], "cell"), "cells")
            quota = quota_allocation(open_.drop("_limit"), profile.target, tuple(cell[:-1])).where("alloc > 0").join(open_.drop("cnt"), [*cell[:-1], "cell"]).withColumnRenamed("cell", cell[-1])
            level = level.join(quota.drop("cnt"), cell, "left")
        level = level.withColumns({f"input{depth}": F.when(F.col("_kind") == "internal", F.col("_in")), "depth": F.when(leaf, F.lit(depth)).otherwise(F.col("depth")), "kind": F.when(leaf, F.col("_kind")).otherwise(F.col("kind")), "input": F.when(leaf, F.col("_in")).otherwise(F.col("input"))})
        level = written(level.drop("_in", "_kind", f"limit{depth}"), "level")
        discard(now)
        if last:
            now = level
            break
        discard(open_)
        quota = level.where("alloc is not null and rest > 0").select(*key, *cell[2:], "done", "alloc", "_limit")
        if quota.isEmpty():
            now = level.drop("alloc", "_limit", "u", "v")
            break
        rows = near.join(few(quota), key).where((F.col("hi") < F.col("_limit")) & (F.col("done").isNull() | (point > F.col("done"))))
        rank = F.row_number().over(Window.partitionBy(*cell).orderBy("hi", "lo", "ordinal"))
        kept = written(rows.withColumn("_rank", rank).where("_rank <= alloc").select(*key, *cell[2:], "alloc", point.alias("point")), "kept")
        cuts = kept.groupBy(*cell).agg(F.count("*").alias("_found"), F.max("point").alias(f"cut{depth}"))
        owned = kept.groupBy(*key).agg(F.count("*").alias("_own"))
        now = level.join(cuts, cell, "left").join(owned, key, "left")
        now = now.withColumns({"rest": F.col("rest") - F.coalesce("_own", F.lit(0)), "done": F.greatest("done", f"cut{depth}"), "_short": F.coalesce("_found", F.lit(0)) < F.col("alloc")})
        now = written(now.drop("_own", "_found", "alloc", "_limit", "u", "v"), "spots")
        discard(level, kept)
        if not now.where("_short").isEmpty():
            discard(now, near)
            return None
        now = now.drop("_short")
    discard(near)
    return now


def residual_tree(points: DataFrame, profile: Profile = Profile(), origin: tuple[float, float] = (-4000.0, -2000.0), keep: tuple[str, ...] = ()) -> DataFrame:
    """Points with their owner: ``ordinal, x, y, z, ix, iy, path, depth, kind, input`` and the columns ``keep``; each input point comes once.

    ``points`` has ordinal, x, y, z, ix, iy, hi, lo, and is written once. Points are counted by spot, where the squares and microcells of
    all depths meet; levels are settled over spots and over the few points with small hashes, and a point is compared once with its
    spot's cuts as it is read. Only where there are over ``FEW`` spots are points shuffled to them and written. A node over
    ``hard`` at the last depth keeps its points as kind ``overflow``. No points: no rows.
    """
    turned = written(_spotted(points.select("ordinal", "x", "y", "z", "ix", "iy", "hi", "lo", *keep), profile, origin), "turned")
    packing = _packing(profile)
    key = ["ix", "iy", *packing]
    parts = {n: F.shiftright(k, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for k, fields in packing.items() for n, at, bits in fields}
    spots = written(turned.groupBy(*key).agg(F.count("*").alias("cnt")).withColumns(parts), "counts")
    spare, held = 6.0, None
    while held is None:
        held = _settled(turned, spots, profile, spare)
        spare *= 16
    depths = [d for d in range(profile.depth) if f"cut{d}" in held.columns]
    point, inner = F.struct("hi", "lo", "ordinal"), F.lit(profile.depth)
    for d in reversed(depths):
        inner = F.when(F.coalesce(point <= F.col(f"cut{d}"), F.lit(False)), F.lit(d)).otherwise(inner)
    wide = held.count() > FEW
    names = ["path", "depth", "kind", "input", *[f"{n}{d}" for d in depths for n in ("cut", "input")]]
    table = held.select(*key, *[F.col(n).alias(f"leaf_{n}") if n in ("depth", "kind", "input", "path") else n for n in names])
    rows = turned.join(table if wide else F.broadcast(table), key).withColumn("_at", inner)
    by_inner = F.col("_at") < profile.depth
    depth = F.when(by_inner, F.col("_at")).otherwise(F.col("leaf_depth"))
    put = F.col("leaf_input")
    for d in depths:
        put = F.when(F.col("_at") == d, F.col(f"input{d}")).otherwise(put)
    rows = rows.withColumn("depth", depth).select("ordinal", "x", "y", "z", "ix", "iy", F.expr("substring(leaf_path, 1, depth)").alias("path"), "depth", F.when(by_inner, F.lit("internal")).otherwise(F.col("leaf_kind")).alias("kind"), put.alias("input"), *keep)
    return written(rows, "tree-0") if wide else rows  # else each read would shuffle the points


def node_manifest(owned: DataFrame, least: int = 200) -> DataFrame:
    """One row a node: counts, bounds of its own points, parent path (null at the root), children and whether a leaf is underfilled."""
    bounds = [f(k).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k in "xyz"]
    nodes = written(owned.groupBy(*NODE, "depth", "kind", "input").agg(F.count("*").alias("emitted"), *bounds), "manifest")  # else the points would be read twice
    nodes = nodes.withColumn("parent", F.when(F.col("depth") > 0, F.expr("substring(path, 1, depth - 1)")))
    below = nodes.where("depth > 0").groupBy("ix", "iy", F.col("parent").alias("path")).agg(F.count("*").alias("children"), F.sum("input").alias("handed"))
    return nodes.join(below, list(NODE), "left").fillna(0, ["children", "handed"]).withColumn("underfilled", (F.col("kind") != "internal") & (F.col("emitted") < least))


def subtree_rollup(nodes: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Nodes with ``error`` and the subtree's bounds ``sub_*``, from the deepest level up: one small join a level.

    A leaf's error is zero; an inner node's is the largest of its own and 1.05 times, or 0.01 more than, its children's largest.
    """
    sides = [f"{n}_{k}" for n in ("min", "max") for k in "xyz"]
    raw = g.representation_error((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")), F.col("emitted"), profile.scale)
    nodes = written(nodes.withColumn("raw", F.when(F.col("kind") == "internal", raw).otherwise(0.0)), "nodes")
    below, levels = None, []
    for depth in range(profile.depth, -1, -1):
        rows = nodes.where(F.col("depth") == depth)
        if below is None:
            done = rows.withColumn("error", F.col("raw")).withColumns({f"sub_{s}": F.col(s) for s in sides})
        else:
            fold = [(F.min if s.startswith("min") else F.max)(f"sub_{s}").alias(f"c_{s}") for s in sides]
            child = below.groupBy("ix", "iy", F.col("parent").alias("path")).agg(F.max("error").alias("c_error"), *fold)
            joined = rows.join(child, list(NODE), "left")
            error = F.greatest("raw", F.col("c_error") * 1.05, F.col("c_error") + 0.01)
            done = joined.withColumn("error", F.when(F.col("kind") == "internal", error).otherwise(0.0))
            done = done.withColumns({f"sub_{s}": (F.least if s.startswith("min") else F.greatest)(s, f"c_{s}") for s in sides}).drop("c_error", *[f"c_{s}" for s in sides])
        below = written(done, "rolled")  # else each level's lineage would hold all deeper joins
        levels.append(below)
    return reduce(DataFrame.unionByName, levels)


def node_accounting(nodes: DataFrame) -> DataFrame:
    """One row a node with ``balanced``: what came in was emitted or handed to its children."""
    return nodes.select(*NODE, "kind", "input", "emitted", "handed", (F.col("input") == F.col("emitted") + F.col("handed")).alias("balanced"))


def leaf_diagnostics(nodes: DataFrame, least_area: float = 1e-6) -> DataFrame:
    """Leaves by ``depth`` and in total (null): median, 95th percentile and maximum of points, extent (longer side) and density, and how many are underfilled or clamped.

    A leaf smaller than ``least_area`` counts with that area and as clamped.
    """
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    figures = {"points": F.col("emitted"), "extent": F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")), "density": F.col("emitted") / F.greatest(area, F.lit(least_area))}
    rows = nodes.where("kind <> 'internal'").select("depth", "underfilled", (area < least_area).alias("clamped"), *[v.cast("double").alias(k) for k, v in figures.items()])
    sums = [v for k in figures for v in (F.percentile(k, 0.5).alias(f"{k}_p50"), F.percentile(k, 0.95).alias(f"{k}_p95"), F.max(k).alias(f"{k}_max"))]
    return rows.rollup("depth").agg(F.count("*").alias("leaves"), *sums, F.count_if("underfilled").alias("underfilled"), F.count_if("clamped").alias("clamped"))
