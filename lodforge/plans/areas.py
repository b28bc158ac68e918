"""Queries of areas: manifest, wrappers, detection, datasets of a mode, document chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodforge.operators import areas as ar
from lodforge.plans import registry as r
from lodforge.plans.pyramids import _REPORTS, reports
from lodforge.sources import points as src

c = F.col
_S = [f"{n}_{k}" for n in ("min", "max") for k in "xyz"]
_STATUS = "CASE ((CAST(right(chunk_id, 1) AS INT) + {}) % 4) WHEN 0 THEN 'ready' WHEN 1 THEN 'building' WHEN 2 THEN 'failed' END"
_VIEWS = f"""{_REPORTS}, numbered AS (SELECT concat('area-', lpad(CAST(row_number() OVER (ORDER BY chunk_id) AS VARCHAR),3,'0')) AS area_id, * FROM reports),
  manifest AS (SELECT area_id, chunk_id, {', '.join(f"CASE WHEN chunk_id = 'chunk-4' THEN {s} ELSE {s} + 10 END AS {s}" for s in _S)}, source_points AS points, {', '.join(f"coalesce({_STATUS.format(k)}, 'not_built') AS {m}" for k, m in enumerate(ar.MODES))} FROM numbered)"""


def manifest(spark, sf):
    """Globe reports, one of them without local bounds, and what has been built of each area."""
    rows = reports(spark, sf)
    framed = rows.select("*", F.lit("globe").alias("mode"), *[F.when(c("chunk_id") != "chunk-4", c(s) + 10).alias(f"enu_{s}") for s in _S])
    named = ar.numbered(rows.select("chunk_id"), "chunk_id")
    state = lambda k: (F.right("chunk_id", F.lit(1)).cast("int") + k) % 4
    built = [named.select(F.concat_ws("/", "area_id", F.lit(m)).alias("dataset"), F.element_at(F.array(F.lit("ready"), F.lit("building"), F.lit("failed"), F.lit(None).cast("string")), state(k) + 1).alias("status")) for k, m in enumerate(ar.MODES)]
    return ar.area_manifest(framed, built[0].unionByName(built[1]).unionByName(built[2]).where("status is not null"))


@r.query("SELECT area_id, chunk_id, true AS globe, " + ", ".join(f"round({s},6) AS {s}" for s in _S) + ", points, explore, detail, context FROM manifest", _VIEWS)
def area_manifest(spark, sf):
    return manifest(spark, sf).withColumns({s: r._r(c(s)) for s in _S})


@r.query("SELECT area_id, n.chunk_id, CASE WHEN n.chunk_id = 'chunk-2' THEN 0 WHEN n.chunk_id = 'chunk-5' THEN 2 ELSE 1 END AS removed, 8 - CASE WHEN n.chunk_id = 'chunk-2' THEN 0 WHEN n.chunk_id = 'chunk-5' THEN 2 ELSE 1 END AS children, CAST((SELECT sum(emitted_points) FILTER (WHERE chunk_id <> 'chunk-2') + sum(emitted_points) FILTER (WHERE chunk_id = 'chunk-5') FROM reports) - CASE WHEN n.chunk_id = 'chunk-2' THEN 0 WHEN n.chunk_id = 'chunk-5' THEN 2 ELSE 1 END * emitted_points AS BIGINT) AS points, n.chunk_id NOT IN ('chunk-2', 'chunk-5') AS valid FROM numbered n", _VIEWS)
def overview_excluding(spark, sf):
    """One chunk has no overview child, another has two."""
    rows = reports(spark, sf).select("chunk_id", c("emitted_points").alias("points"))
    children = rows.where("chunk_id <> 'chunk-2'").unionAll(rows.where("chunk_id = 'chunk-5'"))
    return ar.overview_excluding(manifest(spark, sf), children)


@r.query("SELECT area_id, chunk_id, concat('chunks/', chunk_id, '/tileset.json') AS uri, source_points AS points, round((min_x+max_x)/2,6) AS cx, round((max_z-min_z)/2,6) AS hz, round(CASE WHEN chunk_id = 'chunk-1' THEN 12.5 ELSE sqrt((max_x-min_x)**2+(max_y-min_y)**2+(max_z-min_z)**2) END,6) AS error FROM numbered WHERE chunk_id <> 'chunk-6'", _VIEWS)
def area_detail(spark, sf):
    found = reports(spark, sf).where("chunk_id <> 'chunk-6'").withColumn("error", F.when(c("chunk_id") == "chunk-1", 12.5))
    rows = ar.area_detail(manifest(spark, sf), found)
    return rows.select("area_id", "chunk_id", "uri", "points", r._r(F.element_at("box", 1)).alias("cx"), r._r(F.element_at("box", 12)).alias("hz"), r._r(c("error")).alias("error"))


_SAMPLES = "samples AS (SELECT event_id AS sample_id, user_id AS view_id, value*20 - 2000 AS x, ((event_id % 97)*45 - 1200)::DOUBLE AS y, ((event_id % 11)*5)::DOUBLE AS z, CAST(CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.55 END AS DOUBLE) AS weight FROM events)"
_BOXES = "boxes AS (SELECT area_id, min_x + 400*k AS min_x, min_x + 400*k + 900 AS max_x, min_y + 300*k AS min_y, min_y + 300*k + 1500 AS max_y, min_z + 2*k AS min_z, max_z - 3*k AS max_z FROM (SELECT *, CAST(right(chunk_id, 1) AS INT) AS k FROM areas))"


def _boxes(spark, sf):
    k = F.right("chunk_id", F.lit(1)).cast("int")
    a = src.areas(src.plain_points(spark, sf))
    return a.select("area_id", (c("min_x") + 400 * k).alias("min_x"), (c("min_x") + 400 * k + 900).alias("max_x"), (c("min_y") + 300 * k).alias("min_y"), (c("min_y") + 300 * k + 1500).alias("max_y"), (c("min_z") + 2 * k).alias("min_z"), (c("max_z") - 3 * k).alias("max_z"))


@r.query("""SELECT v.view_id, v.samples, coalesce(matched, 0) AS matched, area_id, score, CASE WHEN area_id IS NULL THEN 'no_area_match' ELSE 'matched' END AS reason FROM (SELECT view_id, count(*) AS samples FROM samples GROUP BY 1) v
  LEFT JOIN (SELECT view_id, count(DISTINCT sample_id) AS matched FROM met GROUP BY 1) m ON m.view_id = v.view_id
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY score DESC, most DESC, foot, area_id) AS place FROM (SELECT view_id, area_id, round(sum(weight * CASE WHEN inside THEN 1.05::DOUBLE ELSE 1 END), 9) AS score, max(weight) AS most, min(foot) AS foot FROM met GROUP BY 1,2)) WHERE place = 1) b ON b.view_id = v.view_id""",
         f"{r._AREAS}, {_SAMPLES}, {_BOXES}, met AS (SELECT s.*, area_id, z BETWEEN min_z - 0.01 AND max_z + 0.01 AS inside, greatest(max_x-min_x,0)*greatest(max_y-min_y,0) AS foot FROM samples s JOIN boxes b ON x BETWEEN min_x - 0.01 AND max_x + 0.01 AND y BETWEEN min_y - 0.01 AND max_y + 0.01)")
def area_detect(spark, sf):
    """Areas cut to overlapping boxes."""
    return ar.detect_area(src.samples(spark, sf), _boxes(spark, sf))


_ASKED = "asked AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'overview' WHEN 1 THEN 'explore' ELSE 'detail' END AS mode, CASE WHEN event_id % 11 <> 0 THEN printf('area-%03d', 1 + event_id % 10) END AS area_id FROM events)"


@r.query("""SELECT event_id, mode, a.area_id, CASE WHEN mode = 'overview' THEN 'survey-overview' WHEN m.area_id IS NOT NULL THEN concat('survey/', a.area_id, '/', mode) ELSE concat('survey-', coalesce(a.area_id, 'area-001'), '-', CASE mode WHEN 'explore' THEN 'p10' ELSE 'full' END) END AS resolved, status,
  CASE WHEN status = 'ready' THEN 'ready' WHEN status = 'building' THEN 'Building' WHEN status = 'failed' THEN 'Failed' WHEN mode = 'detail' THEN 'Build required' ELSE 'Not built yet' END AS label
  FROM asked a LEFT JOIN manifest m ON m.area_id = a.area_id, LATERAL (SELECT CASE mode WHEN 'overview' THEN 'ready' WHEN 'explore' THEN coalesce(m.explore, 'not_built') ELSE coalesce(m.detail, 'not_built') END AS status) s""", f"{_VIEWS}, {_ASKED}")
def dataset_resolve(spark, sf):
    k = c("event_id")
    asked = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.when(k % 3 == 0, "overview").when(k % 3 == 1, "explore").otherwise("detail").alias("mode"), F.when(k % 11 != 0, F.format_string("area-%03d", 1 + k % 10)).alias("area_id"))
    return ar.resolve_dataset(asked, manifest(spark, sf), "survey")


_SIX = ", ".join(f"{n}({k}) AS {n}_{k}" for n in ("min", "max") for k in "xyz")


def _docs(p, name: str, step: int):
    own = p.where(c("ordinal") % step == 0).groupBy("chunk_id").agg(*[f(k).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k in "xyz"], (F.count("*") / 100).alias("error"))
    return own.select(F.col("chunk_id").alias("area_id"), F.concat(F.lit(f"{name}/"), "chunk_id").alias("uri"), *_S, "error")


_HOLD = " AND ".join([f"a.min_{k} - 5 <= b.min_{k} AND a.max_{k} + 5 >= b.max_{k}" for k in "xyz"])


@r.query(f"SELECT o.chunk_id AS area_id, concat('overview/', o.chunk_id) AS overview_uri, concat('explore/', o.chunk_id) AS explore_uri, concat('detail/', o.chunk_id) AS detail_uri, {_HOLD.replace('a.', 'o.').replace('b.', 'e.')} AS holds_explore, {_HOLD.replace('a.', 'e.').replace('b.', 'd.')} AS holds_detail, greatest(o.error, e.error, d.error) AS overview_error, greatest(e.error, d.error) AS explore_error, d.error AS detail_error FROM doc50 o JOIN doc10 e USING (chunk_id) JOIN doc1 d USING (chunk_id)",
         f"{r._CELLS}, " + ", ".join(f"doc{s} AS (SELECT chunk_id, {_SIX}, count(*)/100::DOUBLE AS error FROM cells WHERE ordinal % {s} = 0 GROUP BY 1)" for s in (50, 10, 1)))
def lod_chain(spark, sf):
    """Each chunk at three densities; a thinner one can be smaller than what it leads to."""
    p = src.points(spark, sf)
    return ar.lod_chain(_docs(p, "overview", 50), _docs(p, "explore", 10), _docs(p, "detail", 1), 5.0)
