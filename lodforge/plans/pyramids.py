"""Queries of the fixed pyramid and of reports over chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodforge.functions import geometry as g
from lodforge.operators import pyramid as pyr
from lodforge.operators import reports as rep
from lodforge.plans import registry as r
from lodforge.plans.frames import _OCTREE, octree
from lodforge.sources import points as src

c = F.col
_TABLE = "(VALUES (0,1000,2000.0,4000.0),(1,50,1000.0,1000.0),(2,10,500.0,500.0),(3,2,250.0,250.0),(4,1,50.0,0.0)) l(lvl,step,size,error)"
_OLD = "(VALUES (0,50,2000.0),(1,10,500.0),(2,2,250.0),(3,1,50.0)) l(lvl,step,size)"
_SIZE = "28 + 256 + n*15 + (8 - n*15 % 8) % 8"
_VIEWS = f"""{r._CELLS}, t AS (SELECT lvl, size::DOUBLE AS size, error::DOUBLE AS error, CAST(floor((x+4000)/size) AS INT) AS ix, CAST(floor((y+2000)/size) AS INT) AS iy,
  count(*) FILTER (WHERE ordinal % step = 0) AS n, min(z) AS zmin, max(z) AS zmax FROM points, {_TABLE} GROUP BY 1,2,3,4,5),
  v AS (SELECT ix, iy, [(ix+0.5)*250-4000, (iy+0.5)*250-2000, (zmin+zmax)/2, 375, greatest((zmax-zmin)/2, 500)] AS request FROM t WHERE lvl = 3)"""


def origin(points) -> tuple[float, float]:
    """Grid origin of the data: one row."""
    return tuple(points.agg(*[g.grid_origin(F.min(k)).cast("double") for k in "xy"]).first())


def _points(spark, sf):
    points = src.points(spark, sf)
    return points, origin(points)


@r.query(f"""SELECT t.lvl, t.ix, t.iy, n, CASE WHEN n > 0 THEN {_SIZE} END AS bytes, CASE WHEN n > 0 THEN printf('points/z%d/z%d_x%06d_y%06d.pnts', t.lvl, t.lvl, t.ix, t.iy) END AS uri,
  round((t.ix+0.5)*size-4000, 6) AS cx, round(size/2, 6) AS hx, round((zmax-zmin)/2, 6) AS hz, error, round(v.request[1], 6) AS rx, round(v.request[5], 6) AS rz
  FROM t LEFT JOIN v ON t.lvl = 4 AND v.ix = CAST(floor(t.ix/5.0) AS INT) AND v.iy = CAST(floor(t.iy/5.0) AS INT)""", _VIEWS)
def pyramid_build(spark, sf):
    tiles = pyr.pyramid(*_points(spark, sf))
    at = lambda b, k, n: r._r(F.element_at(b, k)).alias(n)
    return tiles.select("lvl", "ix", "iy", "n", "bytes", "uri", at("box", 1, "cx"), at("box", 4, "hx"), at("box", 12, "hz"), "error", at("request", 1, "rx"), at("request", 12, "rz"))


@r.query("SELECT t.ix, t.iy, round(v.request[1], 6) AS rx, round(v.request[3], 6) AS rz, round(v.request[4], 6) AS hx, round(v.request[5], 6) AS hz FROM t JOIN v ON v.ix = CAST(floor(t.ix/5.0) AS INT) AND v.iy = CAST(floor(t.iy/5.0) AS INT) WHERE t.lvl = 4", _VIEWS)
def request_volume_join(spark, sf):
    points, at = _points(spark, sf)
    rows = pyr.request_volumes(pyr.pyramid_cells(points, at), at)
    return rows.select("ix", "iy", *[r._r(F.element_at("request", k)).alias(n) for k, n in ((1, "rx"), (3, "rz"), (4, "hx"), (12, "hz"))])


@r.query("SELECT ix, iy, round(request[1],6) AS rx, round(request[4],6) AS hx, round(request[5],6) AS hz FROM v", _VIEWS)
def detail_request_volume(spark, sf):
    points, at = _points(spark, sf)
    cells = pyr.pyramid_cells(points, at).where("lvl = 3")
    return cells.withColumn("b", g.detail_volume(c("ix"), c("iy"), c("zmin"), c("zmax"), at, 250.0)).select("ix", "iy", *[r._r(F.element_at("b", k)).alias(n) for k, n in ((1, "rx"), (4, "hx"), (12, "hz"))])


@r.query(f"SELECT lvl, count(*) AS tiles, CAST(sum(n) AS BIGINT) AS points, CAST(sum({_SIZE}) AS BIGINT) AS bytes FROM t WHERE n > 0 GROUP BY 1", _VIEWS)
def pyramid_level_summary(spark, sf):
    return pyr.level_summary(pyr.pyramid_cells(*_points(spark, sf)))


@r.query("SELECT lvl, ix, iy, n FROM t WHERE n > 0", _VIEWS)
def pyramid_upgrade(spark, sf):
    points, at = _points(spark, sf)
    return pyr.upgrade_pyramid(pyr.pyramid_cells(points, at, pyr.OLD_LEVELS), points, at).select("lvl", "ix", "iy", "n")


@r.query(f"""SELECT lvl, CAST(size AS DOUBLE) AS cell, step, tiles, side FROM (
  SELECT *, 'found' AS side FROM (SELECT lvl, size, step, count(DISTINCT (floor((x+4000)/size), floor((y+2000)/size))) AS tiles FROM points, {_OLD} WHERE ordinal % step = 0 GROUP BY 1,2,3)
  UNION ALL SELECT *, 'expected' AS side FROM (SELECT lvl, size, step, count(DISTINCT (floor((x+4000)/size), floor((y+2000)/size))) AS tiles FROM points, (SELECT lvl, step, size FROM {_TABLE}) WHERE ordinal % step = 0 AND lvl < 4 GROUP BY 1,2,3))""", r._CELLS)
def profile_match(spark, sf):
    """Profiles as built: levels with their cells, steps and tile counts of an older pyramid against the newer one's first levels."""
    points, at = _points(spark, sf)

    def measured(levels, most):
        rows = pyr.pyramid_cells(points, at, levels).where((c("n") > 0) & (c("lvl") < most)).groupBy("lvl").agg(F.count("*").alias("tiles"))
        return rows.join(F.broadcast(pyr.profile_rows(levels, spark)), "lvl").select("lvl", "cell", "step", "tiles")

    return pyr.profile_match(measured(pyr.OLD_LEVELS, 4), measured(pyr.LEVELS, 4))


_IDS = r"z0_x-?\d{5,6}_y-?\d{5,6}"
_PROFILES = "profiles AS (SELECT chunk_id AS id, n % 97 - 3 AS least, n % 101 * 3 AS target, n % 89 * 9 AS leaf, n % 83 * 20 AS hard, n % 7 AS depth, n % 5 AS grid, CASE n % 6 WHEN 0 THEN 'inf'::DOUBLE ELSE (n % 6) - 1.0::DOUBLE END AS scale FROM (SELECT chunk_id, count(*) AS n FROM cells GROUP BY 1))"


@r.query(f"""SELECT id, count(*) AS rows, count(*) > 1 AS repeated, NOT regexp_full_match(id, '{_IDS}') AS malformed, NULL AS problem FROM (
  SELECT DISTINCT printf('z0_x%06d_y%06d', ix, iy) AS id FROM cells UNION ALL SELECT DISTINCT CASE WHEN iy = 0 THEN printf('z0_x%06d_y%06d', ix, iy) ELSE printf('z0-%d-%d', ix, iy) END FROM cells WHERE ix >= 2)
  GROUP BY 1 HAVING count(*) > 1 OR NOT regexp_full_match(id, '{_IDS}')
  UNION ALL SELECT id, 1, false, false, problem FROM (SELECT id, concat_ws('; ', CASE WHEN least <= 0 THEN 'least must be positive' END, CASE WHEN least >= target THEN 'least must be below target' END, CASE WHEN target >= leaf THEN 'target must be below leaf' END,
    CASE WHEN leaf >= hard THEN 'leaf must be below hard' END, CASE WHEN depth < 1 THEN 'depth must be at least 1' END, CASE WHEN grid < 1 THEN 'grid must be at least 1' END, CASE WHEN NOT (scale > 0 AND isfinite(scale)) THEN 'scale must be finite and positive' END) AS problem FROM profiles) WHERE problem <> ''""", f"{r._CELLS}, {_PROFILES}")
def profile_check(spark, sf):
    """Ids that are repeated or malformed, and scalars of profiles (one a chunk, made from its count) that contradict each other."""
    points = r._plain_cells(spark, sf)
    cells = points.select("ix", "iy").distinct()
    own = g.tile_id(0, c("ix"), c("iy"))
    asked = cells.where("ix >= 2").select(F.when(c("iy") == 0, own).otherwise(F.format_string("z0-%d-%d", "ix", "iy")).alias("id"))
    n = c("n")
    profiles = points.groupBy(c("chunk_id").alias("id")).agg(F.count("*").alias("n")).select(
        "id", (n % 97 - 3).alias("least"), (n % 101 * 3).alias("target"), (n % 89 * 9).alias("leaf"), (n % 83 * 20).alias("hard"), (n % 7).alias("depth"), (n % 5).alias("grid"), F.when(n % 6 == 0, float("inf")).otherwise(n % 6 - 1.0).alias("scale"))
    ids = pyr.check_ids(cells.select(own.alias("id")).unionAll(asked)).withColumn("problem", F.lit(None).cast("string"))
    odd = pyr.check_profiles(profiles).select("id", F.lit(1).cast("long").alias("rows"), F.lit(False).alias("repeated"), F.lit(False).alias("malformed"), "problem")
    return ids.unionByName(odd)


_BOUNDS = ", ".join(f"{n}({k}) AS {n}_{k}" for n in ("min", "max") for k in "xyz")
_REPORTS = f"""{r._CELLS}, reports AS (SELECT chunk_id, {_BOUNDS}, count(*) AS source_points, count(*) FILTER (WHERE ordinal % 10 = 0) AS emitted_points, count(DISTINCT (ix, iy)) AS tiles,
  bool_or(red > 60000) AND chunk_id <> 'chunk-2' AS has_rgb, 10 AS step, CASE WHEN chunk_id = 'chunk-5' THEN 'LV03' ELSE 'LV95' END AS crs, max(z) AS error_before, min(z) + 1 AS error_after FROM cells GROUP BY chunk_id)"""


def reports(spark, sf):
    rows = r._cells(spark, sf).groupBy("chunk_id").agg(
        *[f(k).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k in "xyz"], F.count("*").alias("source_points"), F.count_if(c("ordinal") % 10 == 0).alias("emitted_points"), F.count_distinct("ix", "iy").alias("tiles"),
        F.bool_or(c("red") > 60000).alias("rgb"), F.max("z").alias("error_before"), (F.min("z") + 1).alias("error_after"))
    return rows.withColumns({"has_rgb": c("rgb") & (c("chunk_id") != "chunk-2"), "step": F.lit(10), "crs": F.when(c("chunk_id") == "chunk-5", "LV03").otherwise("LV95")}).drop("rgb")


_SIDES = ", ".join(f"round({n}({n}_{k}),6) AS {n}_{k}" for n in ("min", "max") for k in "xyz")


@r.query(f"SELECT count(*) AS chunks, {_SIDES}, CAST(sum(source_points) AS BIGINT) AS source_points, CAST(sum(emitted_points) AS BIGINT) AS emitted_points, CAST(sum(tiles) AS BIGINT) AS tiles, bool_or(has_rgb) AS has_rgb, CASE WHEN count(DISTINCT step) = 1 THEN max(step) END AS step, CASE WHEN count(DISTINCT crs) = 1 THEN max(crs) ELSE 'mixed' END AS crs, max(error_before) AS error_before, max(error_after) AS error_after FROM reports", _REPORTS)
def chunk_rollup(spark, sf):
    rows = rep.chunk_rollup(reports(spark, sf))
    return rows.withColumns({s: r._r(c(s)) for s in rep.SIDES})


_DRIFT = "CASE chunk_id WHEN 'chunk-3' THEN 0.0000005 WHEN 'chunk-6' THEN 0.001 ELSE 0.0 END::DOUBLE"


@r.query(f"SELECT chunk_id, CASE WHEN chunk_id <> 'chunk-7' THEN round({_DRIFT}, 7) END AS drift, chunk_id <> 'chunk-6' AS agrees, true AS mixed FROM reports", _REPORTS)
def frame_consistency(spark, sf):
    """Frames as chunk reports state them: one chunk is off by a millimetre, one by less than the tolerance, one is local."""
    off = F.when(c("chunk_id") == "chunk-3", 5e-7).when(c("chunk_id") == "chunk-6", 1e-3).otherwise(0.0)
    framed = reports(spark, sf).select("chunk_id", F.when(c("chunk_id") == "chunk-7", "local").otherwise("globe").alias("mode"), F.array(F.lit(7.5), F.lit(46.5) + off).alias("origin"), F.array(*[F.lit(float(k)) for k in range(16)]).alias("transform"))
    return rep.check_frames(framed).withColumn("drift", r._r(c("drift"), 7))


@r.query("SELECT chunk_id, round(emitted_points / nullif(CASE WHEN chunk_id = 'chunk-0' THEN 0 ELSE source_points END, 0), 9) AS ratio FROM reports", _REPORTS)
def density_ratio(spark, sf):
    """One chunk's source reports no points."""
    source = F.when(c("chunk_id") == "chunk-0", 0).otherwise(c("source_points"))
    return reports(spark, sf).select("chunk_id", r._r(rep.density_ratio(source, c("emitted_points")), 9).alias("ratio"))


@r.query("SELECT chunk_id, coalesce(CASE WHEN chunk_id <> 'chunk-3' THEN emitted_points END, source_points) AS points, tiles, CASE WHEN chunk_id <> 'chunk-4' THEN crs END AS crs FROM reports", _REPORTS)
def dataset_report(spark, sf):
    """Measured points and tiles of every chunk; conversion reports of all but one, systems of all but another."""
    rows = reports(spark, sf)
    measured = rows.select("chunk_id", c("source_points").alias("points"), "tiles")
    reported = rows.where("chunk_id <> 'chunk-3'").select("chunk_id", c("emitted_points").alias("points"))
    return rep.dataset_report(rows.select("chunk_id", F.when(c("chunk_id") != "chunk-4", c("crs")).alias("crs")), measured, reported, "chunk_id").select("chunk_id", "points", "tiles", "crs")


_CANDIDATES = """candidates AS (SELECT chunk_id AS area_id, lvl AS level, 4 - lvl AS place, count(DISTINCT (kx, ky, kz)) * 12 AS tiles, count(*) * 60 AS mean_bytes, count(*) * 900 AS largest_bytes,
  0.09 + 0.001 * (count(*) % 18)::DOUBLE AS density, 2 AS error_before, CASE WHEN lvl = 4 AND chunk_id = 'chunk-1' THEN NULL ELSE 1 END AS error_after, lvl = 3 AND chunk_id = 'chunk-2' AS failed FROM octree WHERE lvl >= 2 GROUP BY 1,2,3),
  named AS (SELECT *, list_filter([CASE WHEN tiles < 200 THEN 'tiles_low' WHEN tiles > 1000 THEN 'tiles_high' END, CASE WHEN mean_bytes < 102400 THEN 'mean_bytes_low' WHEN mean_bytes > 512000 THEN 'mean_bytes_high' END,
  CASE WHEN largest_bytes > 5242880 THEN 'largest_bytes_high' END, CASE WHEN density < 0.095 THEN 'density_low' WHEN density > 0.105 THEN 'density_high' END, CASE WHEN error_after IS NULL THEN 'error_missing' END, CASE WHEN failed THEN 'failed' END], lambda x: x IS NOT NULL) AS reasons FROM candidates),
  judged AS (SELECT *, CASE WHEN failed THEN 'failed' WHEN len(reasons) = 0 THEN 'accepted' ELSE 'needsReview' END AS status FROM named),
  picked AS (SELECT *, coalesce(min(CASE WHEN status = 'accepted' OR NOT list_has_any(reasons, ['tiles_low','tiles_high','mean_bytes_low','mean_bytes_high','largest_bytes_high','failed']) THEN place END) OVER w, max(place) OVER w) AS last, min(place) OVER w AS first FROM judged WINDOW w AS (PARTITION BY area_id))"""


@r.query("SELECT area_id, level, CASE WHEN status = 'accepted' AND place > first THEN 'fallbackAccepted' ELSE status END AS status FROM picked WHERE place = last", f"{_OCTREE}, {_CANDIDATES}")
def pack_level_choice(spark, sf):
    """Candidates from what the octree's levels hold of each chunk, deepest first."""
    rows = octree(spark, sf).where("lvl >= 2").groupBy(c("chunk_id").alias("area_id"), c("lvl").alias("level")).agg((F.count_distinct("kx", "ky", "kz") * 12).alias("tiles"), F.count("*").alias("n"))
    m = rows.select("area_id", "level", (4 - c("level")).alias("place"), "tiles", (c("n") * 60).alias("mean_bytes"), (c("n") * 900).alias("largest_bytes"), (F.lit(0.09) + 0.001 * (c("n") % 18)).alias("density"), F.lit(2).alias("error_before"),
                    F.when(~((c("level") == 4) & (c("area_id") == "chunk-1")), 1).alias("error_after"), ((c("level") == 3) & (c("area_id") == "chunk-2")).alias("failed"))
    return rep.choose_pack_level(rep.pack_reasons(m))


_TIERS = [("transfer", 0.0, 1000.0, 0.0), ("transfer", 1000.0, 10000.0, 0.12), ("transfer", 10000.0, 50000.0, 0.10), ("transfer", 50000.0, None, 0.09), ("requests", 0.0, 500.0, 0.0), ("requests", 500.0, None, 0.0012)]
_TIER_SQL = "(VALUES " + ", ".join(f"('{k}',{a},{'NULL' if b is None else b},{p})" for k, a, b, p in _TIERS) + ") t(kind, low, high, price)"


@r.query(f"SELECT month, kind, round(sum(greatest(least(amount, coalesce(high, 'inf'::DOUBLE)) - low, 0) * price), 6) AS cost FROM (SELECT date_trunc('month', ts)::DATE AS month, unnest(['transfer', 'requests']) AS kind, unnest([sum(transfer)/1000.0, count(*)::DOUBLE]) AS amount FROM timing GROUP BY 1) JOIN {_TIER_SQL} USING (kind) GROUP BY 1,2", r._TIMING)
def tiered_cost(spark, sf):
    months = src.timing(spark, sf).groupBy(F.trunc("ts", "month").alias("month")).agg((F.sum("transfer") / 1000.0).alias("transfer"), F.count("*").cast("double").alias("requests"))
    usage = months.unpivot("month", ["transfer", "requests"], "kind", "amount")
    return rep.tiered_cost(usage, spark.createDataFrame(_TIERS, "kind string, low double, high double, price double")).withColumn("cost", r._r(c("cost")))
