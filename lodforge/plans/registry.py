"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodforge.functions import geometry as g
from lodforge.functions import text as t
from lodforge.operators import audit, sampling
from lodforge.operators.tree import few as tree_few
from lodforge.sources import points as src

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
c = F.col

_POINTS = """points AS (SELECT CAST(ordinal AS BIGINT) AS ordinal, (l_extendedprice*8)/100 - 2600 AS x, (l_suppkey % 100)*37.5 + l_quantity*20 - 1500 AS y,
  l_discount*500 + 0.0 AS z, l_partkey*32 % 65536 AS red, l_orderkey*8 % 65536 AS green, l_linenumber*9000 % 65536 AS blue, concat('chunk-', CAST(l_partkey % 8 AS VARCHAR)) AS chunk_id
  FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_shipdate,l_extendedprice) - 1 AS ordinal FROM lineitem) s)"""
_CELLS = _POINTS + ", cells AS (SELECT *, CAST(floor((x+4000)/2000) AS INT) AS ix, CAST(floor((y+2000)/2000) AS INT) AS iy FROM points)"
_TIMING = """timing AS (SELECT event_id, user_id AS session, ts, CASE WHEN event_id % 7 = 0 THEN 'points/z0/z0_x000001_y000001.pnts'
  ELSE concat('points/adaptive/z0_x000001_y000001/d', CAST(event_id % 7 AS VARCHAR), '_q', CAST(event_id % 4 AS VARCHAR), '.pnts') END AS uri,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(round(value*1000) AS BIGINT) END AS transfer, CAST(round(value*1000) AS BIGINT) AS encoded,
  CAST(round(value*3000) AS BIGINT) AS decoded FROM events WHERE event_type IN ('view','purchase')),
  phases AS (SELECT event_id, user_id AS session, ts, CASE event_type WHEN 'click' THEN 'refining' WHEN 'signup' THEN 'travel' ELSE 'ready' END AS phase FROM events WHERE event_type IN ('click','signup','error'))"""
_AREAS = _POINTS + """, areas AS (SELECT concat('area-', lpad(CAST(row_number() OVER (ORDER BY chunk_id) AS VARCHAR),3,'0')) AS area_id, chunk_id,
  min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, count(*) AS point_count FROM points GROUP BY chunk_id)"""


def query(oracle: str | None, views: str = _POINTS, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = f"WITH {views} {oracle}"
        return f

    return add


def on_points(name: str, oracle: str, f) -> None:
    """A query of points with their root cell, read without a shuffle."""
    query(oracle, _CELLS, name)(lambda spark, sf: f(_plain_cells(spark, sf)))


def on_ordinals(name: str, oracle: str, f) -> None:
    """A query of points with root cell and ordinal, which a session writes once."""
    query(oracle, _CELLS, name)(lambda spark, sf: f(_cells(spark, sf)))


def on_timing(name: str, oracle: str, f) -> None:
    query(oracle, _TIMING, name)(lambda spark, sf: f(src.timing(spark, sf)))


def on_areas(name: str, oracle: str, f) -> None:
    query(oracle, _AREAS, name)(lambda spark, sf: f(src.areas(src.plain_points(spark, sf))))


def with_cells(points: DataFrame, origin: tuple[float, float] = (-4000.0, -2000.0)) -> DataFrame:
    return points.withColumns({"ix": g.cell_index(c("x"), origin[0]), "iy": g.cell_index(c("y"), origin[1])})


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return with_cells(src.points(spark, sf))


def _plain_cells(spark: SparkSession, sf: str) -> DataFrame:
    return with_cells(src.plain_points(spark, sf))


def _r(column, digits: int = 6):
    return F.round(column, digits)


# Sources
on_points("source_profile", "SELECT chunk_id, count(*) AS n, round(min(x),6) AS min_x, round(max(z),6) AS max_z FROM cells GROUP BY ROLLUP(chunk_id)",
          lambda p: p.rollup("chunk_id").agg(F.count("*").alias("n"), _r(F.min("x")).alias("min_x"), _r(F.max("z")).alias("max_z")))
# Filters and projections
on_points("valid_points", "SELECT count(*) AS n FROM cells WHERE isfinite(x) AND isfinite(y) AND isfinite(z)",
          lambda p: p.where(" and ".join(f"not isnan({a}) and abs({a}) < double('Infinity')" for a in "xyz")).agg(F.count("*").alias("n")))
on_ordinals("bounds_filter", "SELECT ordinal, round(x,6) AS x, round(y,6) AS y FROM cells WHERE x BETWEEN -1000 AND 1000 AND y BETWEEN 0 AND 500",
          lambda p: p.where(c("x").between(-1000, 1000) & c("y").between(0, 500)).select("ordinal", _r(c("x")).alias("x"), _r(c("y")).alias("y")))
on_points("selected_cells", "SELECT ix, iy, count(*) AS n FROM cells WHERE (ix,iy) IN ((1,0),(2,1),(3,1)) GROUP BY 1,2",
          lambda p: p.join(F.broadcast(p.sparkSession.createDataFrame([(1, 0), (2, 1), (3, 1)], "ix int, iy int")), ["ix", "iy"], "left_semi").groupBy("ix", "iy").agg(F.count("*").alias("n")))
on_ordinals("rgb_to_u8", "SELECT ordinal, CAST(floor(least(greatest(red/256,0),255)) AS INT) AS r8 FROM cells", lambda p: p.select("ordinal", g.rgb_to_u8(c("red")).alias("r8")))
on_ordinals("detect_color_scale", "SELECT CASE WHEN max(greatest(red,green,blue)) BETWEEN 1 AND 255 THEN 256 END AS scale FROM cells WHERE ordinal < 10000",
          lambda p: p.where("ordinal < 10000").agg(F.when(F.max(F.greatest("red", "green", "blue")).between(1, 255), 256).alias("scale")))
on_ordinals("nested_sample", "SELECT lvl, count(*) AS n, CAST(sum(ordinal) AS BIGINT) AS s FROM cells, (VALUES (0,1000),(1,50),(2,10),(3,2),(4,1)) l(lvl,step) WHERE ordinal % step = 0 GROUP BY 1",
          lambda p: p.select("ordinal", F.explode(g.levels_of(c("ordinal"))).alias("lvl")).groupBy("lvl").agg(F.count("*").alias("n"), F.sum("ordinal").alias("s")))
on_ordinals("role_split", "SELECT CASE WHEN ordinal % 1000 = 0 THEN 'p001' ELSE 'adaptive' END AS role, count(*) AS n FROM cells GROUP BY 1", lambda p: p.groupBy(g.role(c("ordinal")).alias("role")).agg(F.count("*").alias("n")))
on_points("tile_id_format", "SELECT DISTINCT printf('z%d_x%06d_y%06d', 0, ix-2, iy-1) AS tile FROM cells", lambda p: p.select(g.tile_id(0, c("ix") - 2, c("iy") - 1).alias("tile")).distinct())
on_points("tile_id_parse", "SELECT DISTINCT ix-2 AS px, iy-1 AS py, 0 AS lvl FROM cells",
          lambda p: p.select(g.tile_id(0, c("ix") - 2, c("iy") - 1).alias("s")).distinct().select(*[v.alias(n) for v, n in zip(t.parse_tile_id(c("s")), ("lvl", "px", "py"), strict=True)]))
on_timing("node_id_parse", r"SELECT event_id, CASE WHEN uri LIKE '%adaptive%' THEN regexp_extract(uri,'/d(\d+)_q',1) END AS depth, CASE WHEN uri LIKE '%adaptive%' THEN regexp_extract(uri,'_q(\d*)\.pnts',1) END AS path, uri LIKE 'points/z0/%' AS overview FROM timing",
          lambda e: e.select("event_id", *[v.alias(n) for v, n in zip(t.parse_node_uri(c("uri"))[1:], ("depth", "path", "overview"), strict=True)]))
on_timing("uri_is_tileset", "SELECT event_id, CASE WHEN uri LIKE '%.pnts' THEN 'content' WHEN uri LIKE '%.json' THEN 'tileset' ELSE 'other' END AS kind FROM timing", lambda e: e.select("event_id", t.request_kind(c("uri")).alias("kind")))
on_timing("uri_safe", "SELECT event_id, event_id % 3 <> 0 AS safe FROM timing",
          lambda e: e.select("event_id", t.is_contained(F.lit("a"), F.when(c("event_id") % 3 == 0, F.concat(F.lit("../../"), c("uri"))).otherwise(F.concat(F.lit("../"), c("uri")))).alias("safe")))
# Geometry
on_points("grid_origin", "SELECT floor(min(x)/2000)*2000 AS ox, floor(min(y)/2000)*2000 AS oy FROM cells", lambda p: p.agg(g.grid_origin(F.min("x")).cast("double").alias("ox"), g.grid_origin(F.min("y")).cast("double").alias("oy")))
on_ordinals("cell_index", "SELECT ordinal, ix, iy FROM cells", lambda p: p.select("ordinal", "ix", "iy"))
on_points("cell_bounds", "SELECT DISTINCT ix, iy, ix*2000.0::DOUBLE-4000 AS lo_x, ix*2000.0::DOUBLE-2000 AS hi_x FROM cells", lambda p: p.select("ix", "iy").distinct().withColumns({"lo_x": c("ix") * F.lit(2000.0) - 4000, "hi_x": c("ix") * F.lit(2000.0) - 2000}))
on_ordinals("parent_cell", "SELECT ordinal, CAST(floor(floor((x+4000)/50)/5) AS INT) AS px, CAST(floor(floor((y+2000)/50)/5) AS INT) AS py FROM cells",
          lambda p: p.select("ordinal", *[F.floor(g.cell_index(c(a), o, 50.0) / g.RATIOS[4]).cast("int").alias(n) for a, o, n in (("x", -4000.0, "px"), ("y", -2000.0, "py"))]))
on_ordinals("quadrant", "SELECT ordinal, CAST(x >= 3000 AS INT) + 2*CAST(y >= 500 AS INT) AS q FROM cells", lambda p: p.select("ordinal", g.quadrant(c("x"), c("y"), 3000, 500).alias("q")))
_MICRO = "least(greatest(CAST(trunc((y-(iy*2000-2000))/2000*8) AS INT),0),7)*8 + least(greatest(CAST(trunc((x-(ix*2000-4000))/2000*8) AS INT),0),7)"


def _micro(p: DataFrame) -> DataFrame:
    return p.withColumn("cell", g.microcell(c("x"), c("y"), c("ix") * F.lit(2000.0) - 4000, c("iy") * F.lit(2000.0) - 2000, 2000.0, 8))


on_ordinals("microcell", f"SELECT ordinal, {_MICRO} AS cell FROM cells", lambda p: _micro(p).select("ordinal", "cell"))
on_areas("bbox_diagonal", "SELECT area_id, round(sqrt((max_x-min_x)**2+(max_y-min_y)**2+(max_z-min_z)**2),6) AS d FROM areas", lambda a: a.select("area_id", _r(g.diagonal(*[c(f"max_{k}") - c(f"min_{k}") for k in "xyz"])).alias("d")))
on_areas("representation_error", "SELECT area_id, round(sqrt(greatest((max_x-min_x)*(max_y-min_y),1e-6)/greatest(1,point_count))*2,6) AS e FROM areas", lambda a: a.select("area_id", _r(g.representation_error((c("max_x") - c("min_x")) * (c("max_y") - c("min_y")), c("point_count"), 2.0)).alias("e")))
on_areas("pnts_size_estimate", "SELECT area_id, 284 + point_count*15 + (8 - point_count*15 % 8) % 8 AS b FROM areas", lambda a: a.select("area_id", g.estimated_bytes(c("point_count")).alias("b")))
on_areas("bounds_union", "SELECT round(min(min_x),6) AS min_x, round(max(max_x),6) AS max_x, round(min(min_z),6) AS min_z, round(max(max_z),6) AS max_z FROM areas", lambda a: a.agg(*[_r(f(k)).alias(k) for f, k in ((F.min, "min_x"), (F.max, "max_x"), (F.min, "min_z"), (F.max, "max_z"))]))
on_areas("shared_origin", "SELECT round((min(min_x)+max(max_x))/2,6) AS ox, round((min(min_y)+max(max_y))/2,6) AS oy FROM areas", lambda a: a.agg(*[_r((F.min(f"min_{k}") + F.max(f"max_{k}")) / 2).alias(f"o{k}") for k in "xy"]))
on_areas("frontier_volume", "SELECT area_id, round(greatest(100,1.5*(max_x-min_x)),6) AS w, round(greatest(100,1.5*(max_y-min_y)),6) AS h, round(greatest(200,2*(max_z-min_z)),6) AS dz FROM areas",
         lambda a: a.select("area_id", *[_r(F.greatest(F.lit(least), f * (c(f"max_{k}") - c(f"min_{k}")))).alias(n) for k, f, least, n in (("x", 1.5, 100.0, "w"), ("y", 1.5, 100.0, "h"), ("z", 2.0, 200.0, "dz"))]))
on_areas("leaf_density", "SELECT area_id, round((max_x-min_x)*(max_y-min_y),4) AS area, round(point_count/greatest((max_x-min_x)*(max_y-min_y),1e-6),9) AS density FROM areas",
         lambda a: a.withColumn("s", (c("max_x") - c("min_x")) * (c("max_y") - c("min_y"))).select("area_id", _r(c("s"), 4).alias("area"), _r(c("point_count") / F.greatest(c("s"), F.lit(1e-6)), 9).alias("density")))
on_areas("area_numbering", "SELECT area_id, chunk_id FROM areas", lambda a: a.select("area_id", "chunk_id"))
on_ordinals("geodetic_to_ecef", "SELECT ordinal, round((6378137.0/sqrt(1-6.69437999014e-3*sin(radians(y/100))**2)+z)*cos(radians(y/100))*cos(radians(x/1000)),3) AS ex, round((6378137.0/sqrt(1-6.69437999014e-3*sin(radians(y/100))**2)*(1-6.69437999014e-3)+z)*sin(radians(y/100)),3) AS ez FROM cells",
          lambda p: p.select("ordinal", *[_r(v, 3).alias(n) for v, n in zip(g.to_ecef(c("x") / 1000, c("y") / 100, c("z")), ("ex", "ey", "ez"), strict=True) if n != "ey"]))
# Aggregations
on_ordinals("routing_accounting", "SELECT ix, iy, count(*) FILTER (WHERE ordinal % 1000 = 0) AS p001, count(*) FILTER (WHERE ordinal % 1000 <> 0) AS adaptive FROM cells GROUP BY 1,2",
          lambda p: p.groupBy("ix", "iy").agg(F.count_if(c("ordinal") % 1000 == 0).alias("p001"), F.count_if(c("ordinal") % 1000 != 0).alias("adaptive")))
_LEVELS = "(VALUES (0,1000,2000.0),(1,50,1000.0),(2,10,500.0),(3,2,250.0),(4,1,50.0)) l(lvl,step,size)"


def _pyramid(p: DataFrame) -> DataFrame:
    size = F.element_at(F.array(*map(F.lit, g.SIZES.values())), c("lvl") + 1)
    return p.withColumn("lvl", F.explode(g.levels_of(c("ordinal")))).withColumns({"px": F.floor((c("x") + 4000) / size).cast("int"), "py": F.floor((c("y") + 2000) / size).cast("int")})


on_ordinals("pyramid_counts", f"SELECT lvl, CAST(floor((x+4000)/size) AS INT) AS px, CAST(floor((y+2000)/size) AS INT) AS py, count(*) AS n FROM cells, {_LEVELS} WHERE ordinal % step = 0 GROUP BY 1,2,3", lambda p: _pyramid(p).groupBy("lvl", "px", "py").agg(F.count("*").alias("n")))
on_points("content_bounds", "SELECT ix, iy, round(min(x),6) AS min_x, round(max(x),6) AS max_x, round((min(y)+max(y))/2,6) AS mid_y FROM cells GROUP BY 1,2", lambda p: p.groupBy("ix", "iy").agg(_r(F.min("x")).alias("min_x"), _r(F.max("x")).alias("max_x"), _r((F.min("y") + F.max("y")) / 2).alias("mid_y")))
on_points("microcell_occupancy", f"SELECT ix, iy, {_MICRO} AS cell, count(*) AS cnt FROM cells GROUP BY 1,2,3", lambda p: _micro(p).groupBy("ix", "iy", "cell").agg(F.count("*").alias("cnt")))
_OCC = f"(SELECT ix, iy, {_MICRO} AS cell, count(*) AS cnt FROM cells GROUP BY 1,2,3)"
def quota_sql(occupancy: str, node: str = "ix,iy", quota: int = 400) -> str:
    return f"""(WITH a AS (SELECT *, sum(cnt) OVER w AS tot, count(*) OVER w AS n, row_number() OVER (PARTITION BY {node} ORDER BY cnt DESC, cell) AS top FROM {occupancy} WINDOW w AS (PARTITION BY {node})),
 b AS (SELECT *, least({quota},tot) AS q FROM a), d AS (SELECT *, CAST((q-n)*cnt AS DOUBLE)/tot AS t FROM b), e AS (SELECT *, greatest(0,least(floor(t),cnt-1)) AS f FROM d),
 h AS (SELECT *, q-n-sum(f) OVER (PARTITION BY {node}) AS rest, CAST(f+1<cnt AS INT) AS can FROM e),
 i AS (SELECT *, CAST(can=1 AND sum(can) OVER (PARTITION BY {node} ORDER BY t-f DESC, cell ROWS UNBOUNDED PRECEDING) <= rest AS INT) AS b FROM h),
 j AS (SELECT *, rest-sum(b) OVER (PARTITION BY {node}) AS rest2, cnt-1-f-b AS spare FROM i),
 k AS (SELECT *, coalesce(sum(spare) OVER (PARTITION BY {node} ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM j)
 SELECT {node}, cell, cnt, CAST(CASE WHEN q<=n THEN CAST(top<=q AS INT) ELSE 1+f+b+greatest(0,least(spare,rest2-before)) END AS BIGINT) AS alloc FROM k)"""


_QUOTA = quota_sql(_OCC)


def _quota(p: DataFrame) -> DataFrame:
    return sampling.quota_allocation(_micro(p).groupBy("ix", "iy", "cell").agg(F.count("*").alias("cnt")), 400, ("ix", "iy"))


on_points("quota_allocation", f"SELECT * FROM {_QUOTA}", _quota)
on_points("sampling_stats", f"SELECT ix, iy, count(*) AS occupied, count(*) FILTER (WHERE alloc>0) AS represented, CAST(sum(alloc) AS BIGINT) AS quota, round(min(alloc/cnt),9) AS lo, round(max(alloc/cnt),9) AS hi FROM {_QUOTA} GROUP BY 1,2",
          lambda p: _quota(p).groupBy("ix", "iy").agg(F.count("*").alias("occupied"), F.count_if(c("alloc") > 0).alias("represented"), F.sum("alloc").alias("quota"), _r(F.min(c("alloc") / c("cnt")), 9).alias("lo"), _r(F.max(c("alloc") / c("cnt")), 9).alias("hi")))
on_ordinals("quota_join", f"SELECT ordinal, alloc FROM (SELECT ordinal, ix, iy, {_MICRO} AS cell FROM cells) JOIN {_QUOTA} USING (ix,iy,cell)", lambda p: _micro(p).join(tree_few(_quota(p)), ["ix", "iy", "cell"]).select("ordinal", "alloc"))
_CENSUS = "(SELECT ix, iy, count(*) AS n FROM cells GROUP BY 1,2)"
on_points("distribution_summary", f"SELECT count(*) AS cnt, CAST(sum(n) AS BIGINT) AS total, min(n) AS lo, max(n) AS hi, round(avg(n),6) AS mean, round(quantile_cont(n,0.5),6) AS p50, round(quantile_cont(n,0.95),6) AS p95 FROM {_CENSUS}",
          lambda p: p.groupBy("ix", "iy").agg(F.count("*").alias("n")).agg(F.count("*").alias("cnt"), F.sum("n").alias("total"), F.min("n").alias("lo"), F.max("n").alias("hi"), _r(F.avg("n")).alias("mean"), _r(F.percentile("n", 0.5)).alias("p50"), _r(F.percentile("n", 0.95)).alias("p95")))
on_points("dense_cell", f"SELECT ix, iy, n FROM {_CENSUS} ORDER BY n DESC, ix, iy LIMIT 1", lambda p: p.groupBy("ix", "iy").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ix", "iy").limit(1))
on_ordinals("role_disjoint", "SELECT count(*) AS shared FROM (SELECT ordinal FROM cells WHERE ordinal % 1000 = 0 INTERSECT SELECT ordinal FROM cells WHERE ordinal % 1000 <> 0)", lambda p: audit.shared_keys(p.where("ordinal % 1000 = 0"), p.where("ordinal % 1000 <> 0")))
# Telemetry
_FIRST = "coalesce(nullif(transfer,0),nullif(encoded,0),nullif(decoded,0),0)"
on_timing("request_summary", f"SELECT count(*) AS requests, count(*) FILTER (WHERE uri LIKE '%.pnts') AS content, CAST(sum({_FIRST}) AS BIGINT) AS bytes FROM timing",
          lambda e: e.agg(F.count("*").alias("requests"), F.count_if(t.request_kind(c("uri")) == "content").alias("content"), F.sum(F.expr(_FIRST)).alias("bytes")))
on_timing("cache_hit_ratio", "SELECT round(count(*) FILTER (WHERE transfer=0 AND (encoded>0 OR decoded>0)) / nullif(count(*) FILTER (WHERE transfer>0 OR encoded>0 OR decoded>0),0),9) AS ratio FROM timing",
          lambda e: e.agg(_r(F.try_divide(F.count_if(F.expr("transfer=0 and (encoded>0 or decoded>0)")), F.count_if(F.expr("transfer>0 or encoded>0 or decoded>0"))), 9).alias("ratio")))
on_timing("tiles_by_depth", r"SELECT CASE WHEN uri LIKE 'points/z0/%' THEN 'p001' ELSE concat('d', regexp_extract(uri,'/d(\d+)_q',1)) END AS bucket, count(*) AS n FROM timing GROUP BY 1",
          lambda e: e.groupBy(F.when(t.parse_node_uri(c("uri"))[3], "p001").otherwise(F.coalesce(F.concat(F.lit("d"), t.parse_node_uri(c("uri"))[1]), F.lit("other"))).alias("bucket")).agg(F.count("*").alias("n")))
_ASOF = "SELECT t.event_id, CASE WHEN p.phase = 'ready' THEN 'refining' ELSE p.phase END AS phase FROM timing t ASOF JOIN (SELECT session, ts, arg_max(phase, event_id) AS phase FROM phases GROUP BY 1,2) p ON t.session = p.session AND t.ts >= p.ts"
on_timing("human_duration", "SELECT event_id, CASE WHEN decoded >= 3600 THEN concat(lpad(CAST(decoded//3600 AS VARCHAR),2,'0'), ':', lpad(CAST(decoded//60%60 AS VARCHAR),2,'0'), ':', lpad(CAST(decoded%60 AS VARCHAR),2,'0')) ELSE concat(lpad(CAST(decoded//60 AS VARCHAR),2,'0'), ':', lpad(CAST(decoded%60 AS VARCHAR),2,'0')) END AS label FROM (SELECT event_id, decoded % 90000 AS decoded FROM timing)", lambda e: e.select("event_id", t.human_duration(c("decoded") % 90000).alias("label")))


# More expressions and small reports
on_points("leaf_stats", f"SELECT round(quantile_cont(n,0.5),6) AS p50, round(quantile_cont(n,0.95),6) AS p95, max(n) AS largest, round(avg(CAST(n BETWEEN 1000 AND 5000 AS INT)),9) AS accepted, count(*) AS leaves FROM {_CENSUS}",
          lambda p: p.groupBy("ix", "iy").agg(F.count("*").alias("n")).agg(_r(F.percentile("n", 0.5)).alias("p50"), _r(F.percentile("n", 0.95)).alias("p95"), F.max("n").alias("largest"), _r(F.avg(c("n").between(1000, 5000).cast("int")), 9).alias("accepted"), F.count("*").alias("leaves")))
on_points("structural_gate", f"SELECT quantile_cont(n,0.95) <= 10000 AS p95_ok, max(n) <= 6000 AS hard_ok FROM {_CENSUS}",
          lambda p: p.groupBy("ix", "iy").agg(F.count("*").alias("n")).agg((F.percentile("n", 0.95) <= 10000).alias("p95_ok"), (F.max("n") <= 6000).alias("hard_ok")))
on_points("sparse_cell", f"SELECT ix, iy, n FROM {_CENSUS} ORDER BY abs(n - (SELECT quantile_cont(n,0.25) FROM {_CENSUS})), ix, iy LIMIT 1",
          lambda p: (lambda k: k.crossJoin(F.broadcast(k.agg(F.percentile("n", 0.25).alias("q")))).orderBy(F.abs(c("n") - c("q")), "ix", "iy").limit(1).select("ix", "iy", "n"))(p.groupBy("ix", "iy").agg(F.count("*").alias("n"))))
on_points("pyramid_zrange", "SELECT l AS lvl, CAST(floor((x+4000)/s) AS INT) AS px, CAST(floor((y+2000)/s) AS INT) AS py, round(min(z),6) AS lo, round(max(z),6) AS hi FROM cells, (VALUES (0,2000.0),(1,1000.0),(2,500.0),(3,250.0),(4,50.0)) v(l,s) GROUP BY 1,2,3",
          lambda p: _zrange(p))
on_points("occupied_ancestors", "SELECT l AS lvl, count(DISTINCT (floor((x+4000)/s), floor((y+2000)/s))) AS cells FROM cells, (VALUES (0,2000.0),(1,1000.0),(2,500.0),(3,250.0),(4,50.0)) v(l,s) GROUP BY 1", lambda p: _zrange(p).groupBy("lvl").agg(F.count("*").alias("cells")))
on_areas("chunk_limit_filter", "SELECT area_id, chunk_id FROM areas WHERE chunk_id NOT IN ('chunk-1','chunk-2') ORDER BY chunk_id LIMIT 3", lambda a: a.join(a.where(c("chunk_id").isin("chunk-1", "chunk-2")).select("chunk_id"), "chunk_id", "left_anti").orderBy("chunk_id").limit(3).select("area_id", "chunk_id"))


def _zrange(p: DataFrame) -> DataFrame:
    """Height range of every cell: leaves from the points, each coarser level from the cells below it."""
    key = lambda a, o: g.cell_index(c(a), o, g.SIZES[4])
    level = p.groupBy(key("x", -4000.0).alias("px"), key("y", -2000.0).alias("py")).agg(F.min("z").alias("lo"), F.max("z").alias("hi")).withColumn("lvl", F.lit(4))
    every = level
    for k in (4, 3, 2, 1):
        up = lambda name, k=k: F.floor(c(name) / g.RATIOS[k]).cast("int").alias(name)
        level = level.groupBy(up("px"), up("py")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("lvl", F.lit(k - 1))
        every = every.unionByName(level)
    return every.select("lvl", "px", "py", _r(c("lo")).alias("lo"), _r(c("hi")).alias("hi"))


def entry(spark: SparkSession) -> DataFrame:
    """Points per root cell of the smallest dataset."""
    return QUERIES["z0_census"](spark, "/root/testdata/sf0.001")


from lodforge.plans import areas, basics, frames, ledgers, payloads, pyramids, streams, telemetry, tree, walks  # noqa: E402,F401  register further queries
