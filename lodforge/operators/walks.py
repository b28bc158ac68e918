"""Walks over trees and document graphs, one join a level; what goes round is a frontier of narrow rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodforge.functions import geometry as g

from .work import discard, written


def coarse_frontier(tiles: DataFrame, files: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """The first content on every branch below the roots, and one row of totals.

    ``tiles``: tile, parent (null at a root), uri (null without content); ``files``: uri, bytes of the payloads that exist and are
    valid. Branches: ``tile``, ``depth``, ``uri``, ``bytes``, ``problem`` (null, ``missing`` payload, or ``empty``: no content and
    no children). Totals: ``tiles``, ``bytes``, ``deepest``, ``missing``, ``ready`` (some content and no problem). A walk of over
    ``most`` levels raises, as parents then go round in a circle.
    """
    now = written(tiles.where(F.col("parent").isNull()).select("tile", "uri", F.lit(0).alias("depth")), "frontier")
    found = []
    while not now.isEmpty():
        if len(found) > most:
            raise ValueError(f"no content within {most} levels")
        found.append(now)
        inner = now.where("uri is null").select(F.col("tile").alias("parent"), "depth")
        now = written(tiles.select("tile", "uri", "parent").join(inner, "parent").select("tile", "uri", (F.col("depth") + 1).alias("depth")), "frontier")
    every = reduce(DataFrame.unionByName, found, now)
    parents = tiles.where(F.col("parent").isNotNull()).select(F.col("parent").alias("tile")).distinct().withColumn("_p", F.lit(1))
    ends = every.join(parents, "tile", "left").where("uri is not null or _p is null").drop("_p").join(files.select("uri", "bytes"), "uri", "left")
    problem = F.when(F.col("uri").isNull(), "empty").when(F.col("bytes").isNull(), "missing")
    branches = written(ends.select("tile", "depth", "uri", "bytes", problem.alias("problem")), "branches")
    discard(*found, now)
    good = F.col("problem").isNull()
    totals = branches.agg(F.count_if(good).alias("tiles"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.when(good, F.col("depth"))), F.lit(0)).alias("deepest"), F.count_if(~good).alias("missing"))
    return branches, totals.withColumn("ready", (F.col("tiles") > 0) & (F.col("missing") == 0))


def spread(first: DataFrame, links: DataFrame, name: str = "spread") -> DataFrame:
    """``doc``, ``steps`` of ``first`` (doc) and all that it leads to by ``links`` (src, dst): each round asks only from the round before."""
    rounds = [written(first.select("doc", F.lit(0).alias("steps")), name)]
    reached = rounds[0]
    while not rounds[-1].isEmpty():
        further = links.join(rounds[-1].select(F.col("doc").alias("src")), "src").select(F.col("dst").alias("doc")).distinct().join(reached, "doc", "left_anti")
        rounds.append(written(further.withColumn("steps", F.lit(len(rounds))), name))
        reached = reached.unionByName(rounds[-1])
    return reached


def trimmed(links: DataFrame) -> DataFrame:
    """``links`` without those that no circle can hold: round by round those from documents nothing leads to, and to documents that lead nowhere, go."""
    now, before = links, links.count()
    while before:
        after = written(now.join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "trimmed")
        count = after.count()
        if now is not links:
            discard(now)
        now = after
        if count == before:
            break
        before = count
    return now


def colours(links: DataFrame) -> DataFrame:
    """``doc``, ``colour``: the smallest document that leads to it, itself included; a round hands on what changed in the one before."""
    held = moved = written(links.select(F.col("src").alias("doc")).union(links.select("dst")).distinct().withColumn("colour", F.col("doc")), "colours")
    while not moved.isEmpty():
        told = links.join(moved.withColumnRenamed("doc", "src"), "src").groupBy(F.col("dst").alias("doc")).agg(F.min("colour").alias("told"))
        after = written(held.join(told, "doc", "left").select("doc", F.least("colour", "told").alias("colour"), F.coalesce(F.col("told") < F.col("colour"), F.lit(False)).alias("new")), "colours")
        discard(held)
        held, moved = after.select("doc", "colour"), after.where("new").select("doc", "colour")
    return held


def strong_components(links: DataFrame) -> DataFrame:
    """``doc``, ``component`` of every document that lies on a circle of ``links`` (src, dst); the component is its smallest document.

    A round trims the links, gives each document the smallest one leading to it as colour, and takes as components what leads back to
    that document within its colour. At least one component of each colour goes, with all its links. A link to itself is a circle.
    """
    own = links.where("src = dst").select(F.col("src").alias("doc"), F.col("src").alias("component"))
    left = written(links.where("src <> dst").select("src", "dst").distinct(), "left")
    found = None
    while True:
        left = trimmed(left)
        if left.isEmpty():
            break
        colour = colours(left)
        end = lambda side: colour.select(F.col("doc").alias(side), F.col("colour").alias(f"{side}_colour"))  # noqa: B023, E731
        back = left.join(end("src"), "src").join(end("dst"), "dst").where("src_colour = dst_colour").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        part = spread(colour.where("doc = colour"), written(back, "back")).select("doc").join(colour, "doc").withColumnRenamed("colour", "component")
        sizes = part.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        now = written(part.join(sizes, "component", "left_semi").select("doc", "component"), "components")
        found = now if found is None else found.unionByName(now)
        gone = part.select("doc")
        left = written(left.join(gone.withColumnRenamed("doc", "src"), "src", "left_anti").join(gone.withColumnRenamed("doc", "dst"), "dst", "left_anti").select("src", "dst"), "left")
    return own if found is None else found.unionByName(own.join(found, "doc", "left_anti"))


def reachable(docs: DataFrame, refs: DataFrame, entry: str) -> DataFrame:
    """``doc``, ``steps`` (fewest from ``entry``, null if never reached), ``cycle`` (lies on a circle of references) for every document.

    ``refs``: src, dst. A document that refers to an unknown one is no problem here. What only lies between circles is on none.
    """
    known = docs.select("doc").distinct()
    links = written(refs.select("src", "dst").distinct().join(known.withColumnRenamed("doc", "dst"), "dst", "left_semi").join(known.withColumnRenamed("doc", "src"), "src", "left_semi").select("src", "dst"), "links")
    reached = spread(known.where(F.col("doc") == entry), links, "reached")
    circle = strong_components(links).select("doc", F.lit(True).alias("cycle"))
    return known.join(reached, "doc", "left").join(circle, "doc", "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))


_KEY = ("kx", "ky", "kz")


def octree_pack(nodes: DataFrame, group: int, most_bytes: int) -> DataFrame:
    """``nodes`` (lvl, kx, ky, kz, points) with ``pack_lvl``, ``px``, ``py``, ``pz``: the group whose payload holds them.

    Nodes above level ``group`` go into the root's payload (level 0) if that stays within ``most_bytes``, else into groups from
    level 1 on. Others group by their ancestor at level ``group``. A group over the limit that has several nodes is split by the
    ancestors a level deeper, until the deepest level. One aggregation a level; nodes settled leave.
    """
    deepest = nodes.agg(F.max("lvl")).first()[0]
    if deepest is None:
        return nodes.withColumns({"pack_lvl": F.col("lvl"), "px": F.col("kx"), "py": F.col("ky"), "pz": F.col("kz")})
    coarse, fine = nodes.where(F.col("lvl") < group), nodes.where(F.col("lvl") >= group)
    total = coarse.agg(F.sum("points")).first()[0]
    over = total is not None and coarse.agg(g.estimated_bytes(F.sum("points"))).first()[0] > most_bytes
    done = [] if over else [coarse.withColumns({"pack_lvl": F.lit(0), "px": F.lit(0), "py": F.lit(0), "pz": F.lit(0)})]

    def split(rows: DataFrame, level: int) -> None:
        while True:
            to, *key = g.octree_ancestor(F.col("lvl"), tuple(F.col(k) for k in _KEY), level)
            named = rows.withColumns({"pack_lvl": to, "px": key[0], "py": key[1], "pz": key[2]})
            names = ["pack_lvl", "px", "py", "pz"]
            sums = named.groupBy(*names).agg(F.sum("points").alias("_p"), F.count("*").alias("_n"))
            heavy = sums.where((g.estimated_bytes(F.col("_p")) > most_bytes) & (F.col("_n") > 1)).select(*names) if level < deepest else sums.limit(0).select(*names)
            done.append(named.join(heavy, names, "left_anti"))
            rows = written(named.join(heavy, names, "left_semi").drop(*names), "heavy")
            if level >= deepest or rows.isEmpty():
                return
            level += 1

    if over:
        split(coarse, 1)
    split(fine, group)
    return reduce(DataFrame.unionByName, done)


def octree_tree(nodes: DataFrame) -> DataFrame:
    """``lvl``, ``kx``, ``ky``, ``kz``, ``parent`` (level and key; null at the root or if the parent has no node) and ``children`` (keys in order) of every node."""
    one = nodes.select("lvl", *_KEY).distinct()
    up = lambda k: F.floor(F.col(k) / 2).cast("int")
    rows = one.select("*", (F.col("lvl") - 1).alias("pl"), *[up(k).alias(f"p{k}") for k in _KEY])
    below = rows.groupBy("pl", *[f"p{k}" for k in _KEY]).agg(F.array_sort(F.collect_list(F.struct(*_KEY))).alias("children"))  # at most eight a node
    below = below.toDF("lvl", *_KEY, "children").withColumn("lvl", F.col("lvl"))
    known = one.toDF("pl", *[f"p{k}" for k in _KEY]).withColumn("_has", F.lit(True))
    joined = rows.join(known, ["pl", *[f"p{k}" for k in _KEY]], "left").join(below, ["lvl", *_KEY], "left")
    parent = F.when(F.col("_has"), F.concat_ws("-", "pl", *[f"p{k}" for k in _KEY]))
    return joined.select("lvl", *_KEY, parent.alias("parent"), F.coalesce(F.size("children"), F.lit(0)).alias("children"), F.transform("children", lambda c: F.concat_ws("-", *[c[k].cast("string") for k in _KEY])).alias("keys"))


def entry_tile(cells: DataFrame, residual: bool = True) -> DataFrame:
    """The dataset's root over cell tiles (bounds, error): united bounds, ``diagonal`` and ``error``.

    Residual tree: the largest of the diagonal, 1.05 times the largest child's error, and 0.01 more than that. Fixed pyramid:
    twice the diagonal.
    """
    sides = [f"{n}_{k}" for n in ("min", "max") for k in "xyz"]
    root = cells.agg(*[(F.min if s.startswith("min") else F.max)(s).alias(s) for s in sides], F.max("error").alias("child"))
    rows = root.withColumn("diagonal", g.diagonal(*[F.col(f"max_{k}") - F.col(f"min_{k}") for k in "xyz"]))
    error = F.greatest("diagonal", F.col("child") * 1.05, F.col("child") + 0.01) if residual else 2 * F.col("diagonal")
    return rows.withColumn("error", error).drop("child")


def cell_tiles(roots: DataFrame, overview: DataFrame, scale: float = 2.0) -> DataFrame:
    """Root-cell tiles: overview content joined to the residual tree's root, bounds and error over both; a cell without overview has only its root.

    ``roots``: ix, iy, error and ``sub_`` bounds; ``overview``: ix, iy, n, bounds. The error is the largest of the overview's own
    and 1.05 times, or 0.01 more than, the root's.
    """
    sides = [f"{n}_{k}" for n in ("min", "max") for k in "xyz"]
    o = overview.select("ix", "iy", F.col("n").alias("overview_points"), *[F.col(s).alias(f"o_{s}") for s in sides])
    rows = roots.select("ix", "iy", F.col("error").alias("child"), *[F.col(f"sub_{s}").alias(s) for s in sides]).join(o, ["ix", "iy"], "full_outer")
    raw = g.representation_error((F.col("o_max_x") - F.col("o_min_x")) * (F.col("o_max_y") - F.col("o_min_y")), F.col("overview_points"), scale)
    error = F.when(F.col("overview_points").isNull(), F.greatest(F.col("child") * 1.05, F.col("child") + 0.01)).otherwise(F.greatest(raw, F.col("child") * 1.05, F.col("child") + 0.01))
    return rows.select("ix", "iy", "overview_points", *[(F.least if s.startswith("min") else F.greatest)(s, f"o_{s}").alias(s) for s in sides], error.alias("error"))


def validate_tiles(tiles: DataFrame, strict: bool, slack: float = 1e-6) -> DataFrame:
    """Violations (``tile``, ``rule``) of a tree of tiles: tile, parent, refine, box, bounds, error, transform, request.

    Rules: ``refine`` isn't ADD or REPLACE; ``box`` hasn't twelve numbers; ``outside`` its parent on any of six sides; ``error``
    doesn't fall below the parent's (``strict``) or rises above it; ``transform`` below the root; ``request`` differs among the
    children of one parent that have one.
    """
    sides = [f"{n}_{k}" for n in ("min", "max") for k in "xyz"]
    above = tiles.select(F.col("tile").alias("parent"), F.col("error").alias("p_error"), *[F.col(s).alias(f"p_{s}") for s in sides])
    shared = tiles.where(F.col("request").isNotNull()).groupBy("parent").agg((F.count_distinct("request") > 1).alias("_r"))
    rows = tiles.join(above, "parent", "left").join(shared, "parent", "left")
    inside = g.contains(tuple(F.col(f"p_{s}") for s in sides), tuple(F.col(s) for s in sides), slack)
    falls = F.col("error") < F.col("p_error") if strict else F.col("error") <= F.col("p_error")
    has = F.col("p_error").isNotNull()
    rules = {"refine": ~F.coalesce(F.col("refine").isin("ADD", "REPLACE"), F.lit(False)), "box": ~F.coalesce(F.size("box") == 12, F.lit(False)), "outside": has & ~inside, "error": has & ~falls, "transform": F.col("parent").isNotNull() & F.col("transform").isNotNull(), "request": F.col("request").isNotNull() & F.coalesce("_r", F.lit(False))}
    broken = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    return rows.select("tile", F.explode(broken).alias("rule"))
