"""Coordinate chain over the points: the dataset's own origin, its basis and transform, and boxes in its local frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodforge.functions import geometry as g
from lodforge.plans import registry as r
from lodforge.sources import points as src

c = F.col


def _lonlat(x="x", y="y", z="z"):
    """The test points read as degrees and height."""
    return (c(x) / 1000, c(y) / 100, c(z))


def _origin(points):
    """One row: the middle of the dataset in degrees and height, and earth-centred."""
    middle = points.agg(*[((F.min(k) + F.max(k)) / 2).alias(f"o{k}") for k in "xyz"])
    return middle.withColumns({n: v for n, v in zip(("ex", "ey", "ez"), g.to_ecef(*_lonlat("ox", "oy", "oz")), strict=True)})


def _basis():
    return g.enu_basis(*_lonlat("ox", "oy", "oz")[:2])


def _e():
    return tuple(c(k) for k in ("ex", "ey", "ez"))



def _ecef_sql(lon: str, lat: str, h: str) -> tuple[str, str, str]:
    n = f"(6378137.0::DOUBLE/sqrt(1-6.69437999014e-3::DOUBLE*sin(radians({lat}))**2))"
    return f"({n}+{h})*cos(radians({lat}))*cos(radians({lon}))", f"({n}+{h})*cos(radians({lat}))*sin(radians({lon}))", f"({n}*(1-6.69437999014e-3::DOUBLE)+{h})*sin(radians({lat}))"


_X, _Y, _Z = _ecef_sql("ox/1000", "oy/100", "oz")
_L, _P = "radians(ox/1000)", "radians(oy/100)"
_AXES = ((f"-sin({_L})", f"cos({_L})", "0.0"), (f"-sin({_P})*cos({_L})", f"-sin({_P})*sin({_L})", f"cos({_P})"), (f"cos({_P})*cos({_L})", f"cos({_P})*sin({_L})", f"sin({_P})"))
_VIEWS = f"{r._CELLS}, o0 AS (SELECT (min(x)+max(x))/2 AS ox, (min(y)+max(y))/2 AS oy, (min(z)+max(z))/2 AS oz FROM points), o AS (SELECT *, {_X} AS ex, {_Y} AS ey, {_Z} AS ez FROM o0)"


def _enu_sql(p: tuple[str, str, str]) -> list[str]:
    return ["(" + " + ".join(f"(({v}) - {e})*({a})" for v, e, a in zip(p, ("ex", "ey", "ez"), axis, strict=True)) + ")" for axis in _AXES]


_POINT = _ecef_sql("x/1000", "y/100", "z")


@r.query("SELECT " + ", ".join(f"round({v}, 12) AS {a}{k}" for a, axis in zip("enu", _AXES, strict=True) for k, v in zip("xyz", axis, strict=True)) + " FROM o", _VIEWS)
def enu_basis(spark, sf):
    basis = _basis()
    return _origin(src.plain_points(spark, sf)).select(*[r._r(v, 12).alias(f"{a}{k}") for a, axis in zip("enu", basis, strict=True) for k, v in zip("xyz", axis, strict=True)])


@r.query("SELECT k, round(v, 5) AS v FROM (SELECT unnest(range(1, 17)) AS k, unnest([" + ", ".join([f"{v}, 0.0" if k == 2 else v for axis in _AXES for k, v in enumerate(axis)]) + ", ex, ey, ez, 1.0]) AS v FROM o)", _VIEWS)
def enu_transform(spark, sf):
    return _origin(src.plain_points(spark, sf)).select(F.posexplode(g.enu_transform(_e(), _basis())).alias("k", "v")).select((c("k") + 1).cast("long").alias("k"), r._r(c("v"), 5).alias("v"))


def _with_origin(points):
    return points.crossJoin(F.broadcast(_origin(points)))  # one row


@r.query("SELECT ordinal, " + ", ".join(f"round({v}, 1) AS {k}" for k, v in zip("enu", _enu_sql(_POINT), strict=True)) + " FROM points, o", _VIEWS)
def ecef_to_enu(spark, sf):
    return _with_origin(src.points(spark, sf)).select("ordinal", *[r._r(v, 1).alias(k) for k, v in zip("enu", g.to_enu(g.to_ecef(*_lonlat()), _e(), _basis()), strict=True)])


@r.query("SELECT ordinal, " + ", ".join(f"round(CASE WHEN ordinal % 7 = 0 THEN {p} ELSE {v} END, 1) AS {k}" for k, p, v in zip("xyz", _POINT, _enu_sql(_POINT), strict=True)) + " FROM points, o", _VIEWS)
def world_to_frame(spark, sf):
    """Every seventh point comes with a transform that can't be used."""
    transform = F.when(c("ordinal") % 7 != 0, g.enu_transform(_e(), _basis()))
    return _with_origin(src.points(spark, sf)).select("ordinal", *[r._r(v, 1).alias(k) for k, v in zip("xyz", g.world_to_frame(g.to_ecef(*_lonlat()), transform), strict=True)])


_CORNER = _ecef_sql("cx/1000", "cy/100", "cz")


@r.query("SELECT area_id, " + ", ".join(f"round({f}({k}), 2) AS {n}_{k}" for n, f in (("min", "min"), ("max", "max")) for k in "enu")
         + " FROM (SELECT area_id, " + ", ".join(f"{v} AS {k}" for k, v in zip("enu", _enu_sql(_CORNER), strict=True)) + " FROM (SELECT area_id, unnest([min_x, max_x]) AS cx, min_y, max_y, min_z, max_z FROM areas) a, (VALUES (0), (1)) b(i), (VALUES (0), (1)) d(j), o, LATERAL (SELECT CASE i WHEN 0 THEN min_y ELSE max_y END AS cy, CASE j WHEN 0 THEN min_z ELSE max_z END AS cz) e) GROUP BY 1", _VIEWS + r._AREAS[len(r._POINTS):])
def bounds_to_enu(spark, sf):
    points = src.plain_points(spark, sf)
    rows = src.areas(points).crossJoin(F.broadcast(_origin(points)))  # one row
    low, high = g.bounds_to_enu(tuple(c(f"min_{k}") for k in "xyz"), tuple(c(f"max_{k}") for k in "xyz"), lambda x, y, z: g.to_ecef(x / 1000, y / 100, z), _e(), _basis())
    return rows.select("area_id", *[r._r(v, 2).alias(f"{n}_{k}") for n, vs in (("min", low), ("max", high)) for k, v in zip("enu", vs, strict=True)])


_KEYS = "CAST(floor((x+4000)*8/16000) AS INT) AS kx, CAST(floor((y+4000)*8/16000) AS INT) AS ky, CAST(floor(z*8/16000) AS INT) AS kz"
_OCTREE = r._POINTS + """, octree AS (SELECT ordinal, chunk_id, lvl, CAST(floor((x+4000)*w/16000) AS INT) AS kx, CAST(floor((y+4000)*w/16000) AS INT) AS ky, CAST(floor(z*w/16000) AS INT) AS kz
  FROM (SELECT *, CAST(ordinal % 5 AS INT) AS lvl, CASE ordinal % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END AS w FROM points) o)"""


def octree(spark, sf):
    """Points with an octree level (from their ordinal) and key."""
    level = (c("ordinal") % 5).cast("int")
    key = lambda v: F.floor(v * F.pow(F.lit(2.0), c("lvl")) / 16000).cast("int")
    return src.points(spark, sf).withColumn("lvl", level).select("ordinal", "chunk_id", "lvl", key(c("x") + 4000).alias("kx"), key(c("y") + 4000).alias("ky"), key(c("z")).alias("kz"))


@r.query("SELECT ordinal, least(lvl, 2) AS lvl, CAST(floor(kx/2.0**greatest(lvl-2,0)) AS INT) AS kx, CAST(floor(ky/2.0**greatest(lvl-2,0)) AS INT) AS ky, CAST(floor(kz/2.0**greatest(lvl-2,0)) AS INT) AS kz FROM octree", _OCTREE)
def octree_ancestor(spark, sf):
    return octree(spark, sf).select("ordinal", *[v.alias(n) for n, v in zip(("lvl", "kx", "ky", "kz"), g.octree_ancestor(c("lvl"), (c("kx"), c("ky"), c("kz")), 2), strict=True)])


@r.query("SELECT lvl, kx, ky, kz, CASE WHEN lvl = 4 THEN 0 ELSE round((SELECT sqrt((max(x)-min(x))**2+(max(y)-min(y))**2+(max(z)-min(z))**2) FROM points)/2.0**lvl, 6) END AS error FROM (SELECT DISTINCT lvl, kx, ky, kz FROM octree)", _OCTREE)
def level_error(spark, sf):
    root = src.plain_points(spark, sf).agg(g.diagonal(*[F.max(k) - F.min(k) for k in "xyz"]).alias("d"))  # one row
    return octree(spark, sf).select("lvl", "kx", "ky", "kz").distinct().crossJoin(F.broadcast(root)).select("lvl", "kx", "ky", "kz", r._r(g.level_error(c("lvl"), c("lvl") == 4, c("d"))).alias("error"))


r.on_areas("viewer_request_box", "SELECT area_id, round((max_z-min_z)/2,6) AS before, round(greatest((max_z-min_z)/2, 0.5*sqrt((max_x-min_x)**2+(max_y-min_y)**2+(max_z-min_z)**2)/2),6) AS after, round((max_x-min_x)/2,6) AS half_x FROM areas",
           lambda a: _boxes(a).select("area_id", r._r(F.element_at("b", 12)).alias("before"), r._r(F.element_at(g.request_box(c("b"), 0.5), 12)).alias("after"), r._r(F.element_at(g.request_box(c("b"), 0.5), 4)).alias("half_x")))


def _boxes(areas):
    return areas.withColumn("b", g.box(*[tuple(c(f"{n}_{k}") for k in "xyz") for n in ("min", "max")]))
