"""Queries on inventories, cells under work, boxes and tile sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodforge.functions import geometry as g
from lodforge.functions import text as t
from lodforge.operators import ledgers
from lodforge.plans import registry as r
from lodforge.sources import points as src

c = F.col


def _census(p):
    return p.groupBy("ix", "iy").agg(F.count("*").alias("n"))


r.on_timing("missing_content", "SELECT uri, count(*) AS refs FROM timing WHERE uri NOT IN (SELECT uri FROM timing WHERE event_id % 7 IN (0, 2, 3)) GROUP BY 1", lambda e: ledgers.missing_content(e, e.where("event_id % 7 in (0, 2, 3)")))


@r.query("SELECT session, max(n) AS longest FROM (SELECT session, run, count(*) FILTER (WHERE s <= 0) AS n FROM (SELECT *, count(*) FILTER (WHERE s > 0) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT event_id, user_id AS session, ts, CASE WHEN event_id % 3 = 0 THEN 0 ELSE round(value*100000) END AS s FROM events)) WHERE run > 0 GROUP BY 1,2) GROUP BY 1", r._POINTS)
def zero_runs(spark, sf):
    shown = F.when(c("event_id") % 3 == 0, F.lit(0)).otherwise(c("selected_points"))
    return ledgers.zero_runs(src.frames(spark, sf).withColumn("selected_points", shown))


def _pilot(p):
    dense = _census(p).orderBy(F.desc("n"), "ix", "iy").limit(1).select("ix", "iy")
    middle = _census(p).agg(F.percentile("n", 0.25).alias("q"))
    sparse = _census(p).crossJoin(F.broadcast(middle)).orderBy(F.abs(c("n") - c("q")), "ix", "iy").limit(1).select("ix", "iy")  # one row
    return dense.union(sparse).distinct()


r.on_points("pilot_cells", f"(SELECT ix, iy FROM {r._CENSUS} ORDER BY n DESC, ix, iy LIMIT 1) UNION (SELECT ix, iy FROM {r._CENSUS} ORDER BY abs(n - (SELECT quantile_cont(n,0.25) FROM {r._CENSUS})), ix, iy LIMIT 1)", _pilot)
r.on_ordinals("node_bounds", "SELECT ordinal, ix*2000.0::DOUBLE-4000 + floor((x-(ix*2000-4000))/250)*250 AS lo_x, iy*2000.0::DOUBLE-2000 + floor((y-(iy*2000-2000))/250)*250 AS lo_y, 250.0::DOUBLE AS size FROM cells", lambda p: _bounds(p))


def _bounds(p):
    low = [c(i) * F.lit(2000.0) + o for i, o in (("ix", -4000.0), ("iy", -2000.0))]
    place = [F.floor((c(a) - l) / 250.0) for a, l in zip("xy", low, strict=True)]
    path = F.concat(*[(F.shiftright(place[0], k) % 2 + 2 * (F.shiftright(place[1], k) % 2)).cast("string") for k in (2, 1, 0)])
    b = g.node_bounds(*low, path)
    return p.select("ordinal", b["x"].alias("lo_x"), b["y"].alias("lo_y"), b["size"].alias("size"))




def _sides():
    return [tuple(c(f"{n}_{k}") for k in "xyz") for n in ("min", "max")]


r.on_areas("box_from_bounds", "SELECT area_id, round((min_x+max_x)/2,6) AS cx, round((max_y-min_y)/2,6) AS hy, round((max_z-min_z)/2,6) AS hz FROM areas",
           lambda a: a.select("area_id", g.box(*_sides()).alias("b")).select("area_id", *[r._r(F.element_at("b", k)).alias(n) for k, n in ((1, "cx"), (8, "hy"), (12, "hz"))]))
r.on_areas("box_contains", "SELECT area_id, min_x >= -2000 AND max_x <= 6000 AND min_y >= -1450 AND max_y <= 3200 AS inside FROM areas",
           lambda a: a.select("area_id", g.contains(tuple(F.lit(v) for v in (-1950.0, -1400.0, 5950.0, 3150.0)), (c("min_x"), c("min_y"), c("max_x"), c("max_y")), 50.0).alias("inside")))
_TILES = f"(SELECT lvl, floor((x+4000)/size) AS px, floor((y+2000)/size) AS py, count(*) AS n, 284 + count(*)*15 + (8 - count(*)*15 % 8) % 8 AS b FROM cells, {r._LEVELS} WHERE ordinal % step = 0 GROUP BY 1,2,3)"


def _tiles(p):
    return r._pyramid(p).groupBy("lvl", "px", "py").agg(F.count("*").alias("n")).withColumn("b", g.estimated_bytes(c("n")))


r.on_ordinals("tile_size_metrics", f"SELECT count(*) AS tiles, CAST(sum(b) AS BIGINT) AS total, CAST(sum(b) // count(*) AS BIGINT) AS mean, max(b) AS largest, (SELECT max(n) FROM (SELECT n FROM {_TILES} ORDER BY b DESC LIMIT 64)) AS most_points FROM {_TILES}",
            lambda p: (lambda k: k.agg(F.count("*").alias("tiles"), F.sum("b").alias("total"), F.floor(F.sum("b") / F.count("*")).alias("mean"), F.max("b").alias("largest"))
                       .crossJoin(F.broadcast(k.orderBy(F.desc("b")).limit(64).agg(F.max("n").alias("most_points")))))(_tiles(p)))
r.on_timing("human_meters", "SELECT event_id, concat(CASE WHEN m < 0 THEN '-' ELSE '' END, CASE WHEN abs(m) >= 10000 THEN concat(printf('%.1f', abs(m)/1000.0::DOUBLE), ' km') WHEN abs(m) >= 1000 THEN concat(printf('%.2f', abs(m)/1000.0::DOUBLE), ' km') ELSE concat(abs(m), ' m') END) AS label FROM (SELECT event_id, decoded % 500 * 100 - 25000 AS m FROM timing)",
            lambda e: e.select("event_id", t.human_meters(c("decoded") % 500 * 100 - 25000).alias("label")))
