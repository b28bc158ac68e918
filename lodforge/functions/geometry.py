"""Grid, tree and box expressions, all Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = 2000.0
#: Cells of level l in one of level l-1; steps of the nested samples.
RATIOS, STEPS = {1: 2, 2: 2, 3: 2, 4: 5}, {0: 1000, 1: 50, 2: 10, 3: 2, 4: 1}
SIZES = {0: 2000.0, 1: 1000.0, 2: 500.0, 3: 250.0, 4: 50.0}


def cell_index(c: Column, origin: float | Column, cell: float = CELL) -> Column:
    return F.floor((c - origin) / cell).cast("int")


def grid_origin(least: Column, cell: float = CELL) -> Column:
    return F.floor(least / cell) * cell


def tile_id(level, ix: Column, iy: Column) -> Column:
    return F.format_string("z%d_x%06d_y%06d", level if isinstance(level, Column) else F.lit(level), ix, iy)


def quadrant(x: Column, y: Column, cx, cy) -> Column:
    return (x >= cx).cast("int") + 2 * (y >= cy).cast("int")


def microcell(x: Column, y: Column, min_x: Column, min_y: Column, size: float, grid: int) -> Column:
    place = lambda c, low: F.least(F.greatest(((c - low) / size * grid).cast("int"), F.lit(0)), F.lit(grid - 1))
    return place(y, min_y) * grid + place(x, min_x)


def levels_of(ordinal: Column) -> Column:
    """Levels of the nested samples that hold an ordinal."""
    return F.filter(F.array(*[F.lit(k) for k in STEPS]), lambda k: ordinal % F.element_at(F.array(*[F.lit(s) for s in STEPS.values()]), k + 1) == 0)


def role(ordinal: Column) -> Column:
    return F.when(ordinal % 1000 == 0, F.lit("p001")).otherwise(F.lit("adaptive"))


def rgb_to_u8(c: Column, scale: int = 256) -> Column:
    return F.least(F.greatest(c / scale, F.lit(0)), F.lit(255)).cast("int")


def diagonal(*sides: Column) -> Column:
    return F.sqrt(sum((s * s for s in sides), F.lit(0.0)))


def representation_error(area: Column, n: Column, scale: float) -> Column:
    return F.sqrt(F.greatest(area, F.lit(1e-6)) / F.greatest(F.lit(1), n)) * scale


def estimated_bytes(n: Column, point_bytes: int = 15) -> Column:
    return 28 + 256 + n * point_bytes + F.pmod(-n * point_bytes, F.lit(8))


def to_ecef(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """WGS84 longitude and latitude in degrees to earth-centred metres."""
    a, e2 = 6378137.0, 6.69437999014e-3
    p, l = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    return (n + height) * F.cos(p) * F.cos(l), (n + height) * F.cos(p) * F.sin(l), (n * (1 - e2) + height) * F.sin(p)


def enu_basis(lon: Column, lat: Column) -> tuple[tuple[Column, ...], ...]:
    """East, north and up unit vectors of an origin in degrees."""
    l, p = F.radians(lon), F.radians(lat)
    sl, cl, sp, cp = F.sin(l), F.cos(l), F.sin(p), F.cos(p)
    return (-sl, cl, F.lit(0.0)), (-sp * cl, -sp * sl, cp), (cp * cl, cp * sl, sp)


def to_enu(point: tuple[Column, ...], origin: tuple[Column, ...], basis) -> tuple[Column, ...]:
    moved = [p - o for p, o in zip(point, origin, strict=True)]
    return tuple(sum((m * b for m, b in zip(moved, axis, strict=True)), F.lit(0.0)) for axis in basis)


def node_bounds(min_x: Column, min_y: Column, path: Column, size: float = CELL) -> Column:
    """Struct (x, y, size) of the node at a base-4 path below a cell, by repeated bisection."""
    start = F.struct(min_x.cast("double").alias("x"), min_y.cast("double").alias("y"), F.lit(float(size)).alias("size"))
    digits = F.filter(F.split(path, ""), lambda d: d != "")

    def half(b, d):
        step, digit = b["size"] / 2, d.cast("int")
        return F.struct((b["x"] + (digit % 2) * step).alias("x"), (b["y"] + F.floor(digit / 2) * step).alias("y"), step.alias("size"))

    return F.aggregate(digits, start, half)


def box(low: tuple[Column, ...], high: tuple[Column, ...]) -> Column:
    """Centre and three half axes as twelve numbers."""
    half = [(h - l) / 2 for l, h in zip(low, high, strict=True)]
    zero = F.lit(0.0)
    return F.array(*[(h + l) / 2 for l, h in zip(low, high, strict=True)], half[0], zero, zero, zero, half[1], zero, zero, zero, half[2])


def contains(outer: tuple[Column, ...], inner: tuple[Column, ...], eps: float) -> Column:
    """(min..., max...) of ``outer`` holds that of ``inner`` on each axis, up to ``eps``."""
    n = len(outer) // 2
    checks = [i >= o - eps if k < n else i <= o + eps for k, (o, i) in enumerate(zip(outer, inner, strict=True))]
    return F.forall(F.array(*checks), lambda ok: ok)


def enu_transform(origin: tuple[Column, ...], basis) -> Column:
    """Basis and origin as sixteen numbers, one axis after the other."""
    return F.array(*[v for axis in basis for v in (*axis, F.lit(0.0))], *origin, F.lit(1.0))


def world_to_frame(point: tuple[Column, ...], transform: Column) -> tuple[Column, ...]:
    """``point`` in the frame of a sixteen-number transform; unchanged if that is null, of another length or not finite."""
    usable = F.coalesce((F.size(transform) == 16) & F.forall(transform, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    at = lambda k: F.try_element_at(transform, F.lit(k + 1))
    moved = [p - at(12 + k) for k, p in enumerate(point)]
    return tuple(F.when(usable, sum((m * at(4 * axis + k) for k, m in enumerate(moved)), F.lit(0.0))).otherwise(point[axis]) for axis in range(3))


def bounds_to_enu(low: tuple[Column, ...], high: tuple[Column, ...], place, origin: tuple[Column, ...], basis) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Bounds of a box's eight corners in the local frame; ``place`` takes a corner to earth-centred metres."""
    corners = [to_enu(place(*[(high if k >> axis & 1 else low)[axis] for axis in range(3)]), origin, basis) for k in range(8)]
    return tuple(F.least(*[c[axis] for c in corners]) for axis in range(3)), tuple(F.greatest(*[c[axis] for c in corners]) for axis in range(3))


def octree_ancestor(level: Column, key: tuple[Column, ...], to: int) -> tuple[Column, ...]:
    """Level and key of the ancestor at level ``to``; a key at or above that level is its own."""
    steps = F.pow(F.lit(2.0), F.greatest(level - to, F.lit(0)))
    return (F.least(level, F.lit(to)), *[F.floor(k / steps).cast("int") for k in key])


def level_error(level: Column, is_leaf: Column, diagonal_: Column) -> Column:
    """Half the error a level, from the root's diagonal; none for a tile without children."""
    return F.when(is_leaf, F.lit(0.0)).otherwise(diagonal_ / F.pow(F.lit(2.0), level))


def detail_volume(ix: Column, iy: Column, low: Column, high: Column, origin: tuple[float, float], cell: float, scale: float = 3.0, least: float = 500.0) -> Column:
    """Request box that all leaves of a parent cell share: its square ``scale`` times as wide, its half height at least ``least``."""
    zero, half = F.lit(0.0), F.lit(cell / 2 * scale)
    return F.array((ix + 0.5) * cell + origin[0], (iy + 0.5) * cell + origin[1], (low + high) / 2, half, zero, zero, zero, half, zero, zero, zero, F.greatest((high - low) / 2, F.lit(least)))


def request_box(box_: Column, ratio: float) -> Column:
    """A box whose vertical half axis is stretched to ``ratio`` times its half diagonal, if that is longer; null for a flat axis."""
    at = lambda k: F.element_at(box_, k)
    lengths = [diagonal(at(k), at(k + 1), at(k + 2)) for k in (4, 7, 10)]
    factor = F.greatest(lengths[2], diagonal(*lengths) * ratio) / F.nullif(lengths[2], F.lit(0.0))
    return F.when(factor.isNotNull() & (lengths[0] > 0) & (lengths[1] > 0), F.concat(F.slice(box_, 1, 9), F.transform(F.slice(box_, 10, 3), lambda v: v * factor)))
