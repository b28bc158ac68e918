"""Queries that walk trees of tiles and graphs of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodforge.functions import geometry as g
from lodforge.operators import pyramid as pyr
from lodforge.operators import reports as rep
from lodforge.operators import tree, walks
from lodforge.plans import registry as r
from lodforge.plans import tree as tp
from lodforge.plans.frames import _OCTREE, octree
from lodforge.plans.pyramids import _TABLE, _points
from lodforge.sources import points as src

c = F.col
_NODES = f"{_OCTREE}, nodes AS (SELECT lvl, kx, ky, kz, count(*) AS points FROM octree GROUP BY 1,2,3,4)"


def nodes(spark, sf):
    return octree(spark, sf).groupBy("lvl", "kx", "ky", "kz").agg(F.count("*").alias("points"))


_UP = "CAST(floor({}/2.0) AS INT)"


@r.query(f"""SELECT n.lvl, n.kx, n.ky, n.kz, CASE WHEN p.lvl IS NOT NULL THEN concat_ws('-', p.lvl, p.kx, p.ky, p.kz) END AS parent, coalesce(k.children, 0) AS children FROM nodes n LEFT JOIN nodes p ON p.lvl = n.lvl - 1 AND p.kx = {_UP.format('n.kx')} AND p.ky = {_UP.format('n.ky')} AND p.kz = {_UP.format('n.kz')}
  LEFT JOIN (SELECT lvl - 1 AS lvl, {_UP.format('kx')} AS kx, {_UP.format('ky')} AS ky, {_UP.format('kz')} AS kz, count(*)::INT AS children FROM nodes GROUP BY 1,2,3,4) k ON (k.lvl, k.kx, k.ky, k.kz) = (n.lvl, n.kx, n.ky, n.kz)""", _NODES)
def octree_tree(spark, sf):
    return walks.octree_tree(nodes(spark, sf)).drop("keys")


LIMIT, GROUP = 60_000, 2
_BYTES = "(284 + sum(points)*15 + (8 - sum(points)*15 % 8) % 8)"


def _pack_views() -> str:
    at = lambda v, level: f"CAST(floor({v}/2.0**greatest(lvl-{level},0)) AS INT)"
    views, rows = [], f"(SELECT lvl, kx, ky, kz, points FROM nodes WHERE lvl >= {GROUP})"
    for level in (2, 3, 4):
        views.append(f"g{level} AS (SELECT *, least(lvl,{level}) AS pack_lvl, {at('kx', level)} AS px, {at('ky', level)} AS py, {at('kz', level)} AS pz FROM {rows})")
        heavy = f"{_BYTES} > {LIMIT} AND count(*) > 1" if level < 4 else "false"
        views.append(f"h{level} AS (SELECT pack_lvl, px, py, pz FROM g{level} GROUP BY 1,2,3,4 HAVING {heavy})")
        rows = f"(SELECT lvl, kx, ky, kz, points FROM g{level} WHERE (pack_lvl, px, py, pz) IN (SELECT (pack_lvl, px, py, pz) FROM h{level}))"
    return ", ".join(views)


@r.query("SELECT lvl, kx, ky, kz, points, 0 AS pack_lvl, 0 AS px, 0 AS py, 0 AS pz FROM nodes WHERE lvl < 2 AND (SELECT " + _BYTES + " FROM nodes WHERE lvl < 2) <= 1000000 UNION ALL "
         + " UNION ALL ".join(f"SELECT * FROM g{k} WHERE (pack_lvl, px, py, pz) NOT IN (SELECT (pack_lvl, px, py, pz) FROM h{k})" for k in (2, 3, 4)), f"{_NODES}, {_pack_views()}")
def octree_pack(spark, sf):
    held = nodes(spark, sf)
    fine = walks.octree_pack(held.where("lvl >= 2"), GROUP, LIMIT)
    return walks.octree_pack(held.where("lvl < 2"), GROUP, 1_000_000).unionByName(fine)


_TILES = f"""{r._CELLS}, t AS (SELECT lvl, CAST(floor((x+4000)/size) AS INT) AS ix, CAST(floor((y+2000)/size) AS INT) AS iy, count(*) FILTER (WHERE ordinal % step = 0) AS n FROM points, {_TABLE} GROUP BY 1,2,3),
  f AS (SELECT lvl, ix, iy, n > 0 AND (ix + iy) % 3 <> 0 AS has FROM t),
  w0 AS (SELECT * FROM f WHERE lvl = 0), """ + ", ".join(
    f"w{k} AS (SELECT f.* FROM f JOIN (SELECT ix, iy FROM w{k - 1} WHERE NOT has) p ON f.lvl = {k} AND CAST(floor(f.ix/{m}.0) AS INT) = p.ix AND CAST(floor(f.iy/{m}.0) AS INT) = p.iy)" for k, m in ((1, 2), (2, 2), (3, 2), (4, 5)))


def _frontier(spark, sf):
    """Pyramid tiles of which a third lost their content, and payloads of which some are missing."""
    points, at = _points(spark, sf)
    cells = pyr.pyramid_cells(points, at)
    name = lambda lvl, ix, iy: F.concat_ws("/", lvl, ix, iy)
    ratio = F.element_at(F.array(*[F.lit(v) for v in (1, 2, 2, 2, 5)]), c("lvl") + 1)
    parent = F.when(c("lvl") > 0, name(c("lvl") - 1, F.floor(c("ix") / ratio), F.floor(c("iy") / ratio)))
    own = name(c("lvl"), c("ix"), c("iy"))
    tiles = cells.select(own.alias("tile"), parent.alias("parent"), F.when((c("n") > 0) & ((c("ix") + c("iy")) % 3 != 0), own).alias("uri"))
    files = cells.where((c("n") > 0) & (c("ix") % 7 != 1)).select(own.alias("uri"), g.estimated_bytes(c("n")).alias("bytes"))
    return walks.coarse_frontier(tiles, files)


_ENDS = " UNION ALL ".join(f"SELECT w.lvl, w.ix, w.iy, w.has, t.n FROM w{k} w JOIN t USING (lvl, ix, iy)" + (" WHERE has" if k < 4 else "") for k in range(5))


@r.query(f"SELECT concat_ws('/', lvl, ix, iy) AS tile, lvl AS depth, CASE WHEN has AND ix % 7 <> 1 THEN 284 + n*15 + (8 - n*15 % 8) % 8 END AS bytes, CASE WHEN NOT has THEN 'empty' WHEN ix % 7 = 1 THEN 'missing' END AS problem FROM ({_ENDS})", _TILES)
def coarse_frontier(spark, sf):
    return _frontier(spark, sf)[0].select("tile", "depth", "bytes", "problem")


_WALK = "docs AS (SELECT DISTINCT user_id AS doc FROM events), refs AS (SELECT DISTINCT e.user_id AS src, (e.user_id * 3 + e.event_id % 4) % (SELECT count(*) FROM docs) AS dst FROM events e WHERE e.event_id % 9 = 0)"


@r.query("""SELECT doc, min(steps) AS steps, doc IN (SELECT src FROM path WHERE src = dst) AS cycle FROM (SELECT doc, NULL AS steps FROM docs UNION ALL SELECT doc, steps FROM reached) GROUP BY 1""",
         f"RECURSIVE {_WALK}, links AS (SELECT DISTINCT src, dst FROM refs WHERE dst IN (SELECT doc FROM docs)), reached(doc, steps) AS (SELECT min(doc), 0 FROM docs UNION SELECT dst, steps + 1 FROM reached JOIN links ON src = doc WHERE steps < 40), path(src, dst) AS (SELECT src, dst FROM links UNION SELECT p.src, l.dst FROM path p JOIN links l ON l.src = p.dst)")
def reachability(spark, sf):
    """Users as documents that refer to others by arithmetic on the events' ids."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    docs = events.select(c("user_id").alias("doc")).distinct()
    few = docs.agg(F.count("*").alias("n"), F.min("doc").alias("first")).first()
    refs = events.where("event_id % 9 = 0").select(c("user_id").alias("src"), ((c("user_id") * 3 + c("event_id") % 4) % few["n"]).alias("dst"))
    return walks.reachable(docs, refs, few["first"]).select("doc", "steps", "cycle")


_ROOTS = ", ".join(f"{n}({k}) AS {n}_{k}" for n in ("min", "max") for k in "xyz")
_SIDES = [f"{n}_{k}" for n in ("min", "max") for k in "xyz"]


@r.query("SELECT " + ", ".join(f"round({s[:3]}({s}),6) AS {s}" for s in _SIDES) + ", round(sqrt((max(max_x)-min(min_x))**2+(max(max_y)-min(min_y))**2+(max(max_z)-min(min_z))**2),6) AS diagonal, round(greatest(sqrt((max(max_x)-min(min_x))**2+(max(max_y)-min(min_y))**2+(max(max_z)-min(min_z))**2), max(error)*1.05, max(error)+0.01),6) AS error FROM (SELECT *, sqrt((max_x-min_x)**2+(max_y-min_y)**2) AS error FROM (SELECT ix, iy, " + _ROOTS + " FROM cells GROUP BY 1,2))", r._CELLS)
def entry_tile(spark, sf):
    cells = r._plain_cells(spark, sf).groupBy("ix", "iy").agg(*[f(k).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k in "xyz"])
    rows = walks.entry_tile(cells.withColumn("error", g.diagonal(c("max_x") - c("min_x"), c("max_y") - c("min_y"))))
    return rows.withColumns({k: r._r(c(k)) for k in (*_SIDES, "diagonal", "error")})


_OVER = f"(SELECT ix, iy, count(*) AS n, {_ROOTS} FROM cells WHERE ordinal % 1000 = 0 AND ix <> 3 GROUP BY 1,2)"


@r.query(f"SELECT k.ix, k.iy, n AS overview_points, " + ", ".join(f"round({'least' if s.startswith('min') else 'greatest'}(k.sub_{s}, o.{s}),6) AS {s}" for s in _SIDES)
         + f", round(CASE WHEN n IS NULL THEN greatest(error*1.05, error+0.01) ELSE greatest(sqrt(greatest((o.max_x-o.min_x)*(o.max_y-o.min_y),1e-6)/greatest(1,n))*2, error*1.05, error+0.01) END,6) AS error FROM (SELECT * FROM u0) k LEFT JOIN {_OVER} o ON o.ix = k.ix AND o.iy = k.iy", tp._ROLLUP)
def cell_document_rows(spark, sf):
    """Overview content beside the residual tree's roots; cells of one column have no overview."""
    overview = r._cells(spark, sf).where("ordinal % 1000 = 0 and ix <> 3").groupBy("ix", "iy").agg(F.count("*").alias("n"), *[f(k).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k in "xyz"])
    rows = walks.cell_tiles(tp._rolled(spark, sf).where("depth = 0"), overview)
    return rows.withColumns({k: r._r(c(k)) for k in (*_SIDES, "error")})


_MOVED = "CASE WHEN depth > 0 AND path LIKE '%3' THEN {} + 5 ELSE {} END"


def _documents(spark, sf):
    """Rolled-up nodes as tiles, with planted faults: shifted sides, equal errors, modes, boxes, transforms and volumes that break the rules."""
    n = tp._rolled(spark, sf)
    name = lambda p: F.concat_ws("/", "ix", "iy", F.concat(F.lit("r"), p))
    last = F.right("path", F.lit(1))
    deep = c("depth") > 0
    shifted = {s: F.when(deep & (last == "3"), c(f"sub_{s}") + 5).otherwise(c(f"sub_{s}")) for s in _SIDES}
    return n.select(
        name(c("path")).alias("tile"), F.when(deep, name(c("parent"))).alias("parent"), F.when(deep & (last == "1") & (c("ix") == 2), F.lit("KEEP")).otherwise("ADD").alias("refine"), F.array_repeat(F.lit(0.0), F.when(deep & (last == "2") & (c("iy") == 0), 11).otherwise(12)).alias("box"),
        *[v.alias(s) for s, v in shifted.items()], F.when(deep & (last == "0") & (c("ix") == 1), F.lit(1e9)).otherwise(c("error")).alias("error"), F.when(last == "1", F.lit("moved")).alias("transform"), F.when(deep, F.when((last == "2") & (c("ix") == 2), "b").otherwise("a")).alias("request"))


def _fault_views() -> str:
    last = "right(path, 1)"
    sides = ", ".join(f"CASE WHEN depth > 0 AND {last} = '3' THEN sub_{s} + 5 ELSE sub_{s} END AS {s}" for s in _SIDES)
    return f"""every AS ({tp._ALL}), docs AS (SELECT concat_ws('/', ix, iy, concat('r', path)) AS tile, CASE WHEN depth > 0 THEN concat_ws('/', ix, iy, concat('r', parent)) END AS parent, depth, {sides}, CASE WHEN depth > 0 AND {last} = '0' AND ix = 1 THEN 1e9 ELSE error END AS error,
      depth > 0 AND {last} = '1' AND ix = 2 AS bad_refine, depth > 0 AND {last} = '2' AND iy = 0 AS bad_box, depth > 0 AND {last} = '1' AS moved, CASE WHEN depth > 0 THEN CASE WHEN {last} = '2' AND ix = 2 THEN 'b' ELSE 'a' END END AS request FROM every),
    met AS (SELECT d.*, p.tile IS NOT NULL AS has, d.error < p.error AS falls, {" AND ".join(f"d.min_{k} >= p.min_{k} - 1e-6 AND d.max_{k} <= p.max_{k} + 1e-6" for k in "xyz")} AS inside, count(DISTINCT d.request) OVER (PARTITION BY d.parent) AS volumes FROM docs d LEFT JOIN docs p ON p.tile = d.parent)"""


@r.query("SELECT tile, 'refine' AS rule FROM met WHERE bad_refine UNION ALL SELECT tile, 'box' FROM met WHERE bad_box UNION ALL SELECT tile, 'outside' FROM met WHERE has AND NOT inside UNION ALL SELECT tile, 'error' FROM met WHERE has AND NOT falls UNION ALL SELECT tile, 'transform' FROM met WHERE moved UNION ALL SELECT tile, 'request' FROM met WHERE request IS NOT NULL AND volumes > 1", f"{tp._ROLLUP}, {_fault_views()}")
def tree_validate(spark, sf):
    return walks.validate_tiles(_documents(spark, sf), strict=True)


_TREE_TILES = "tiles AS (SELECT n.*, 284 + emitted*15 + (8 - emitted*15 % 8) % 8 AS bytes FROM nodes n)"


@r.query("""SELECT unnest(['points', 'bytes', 'tiles', 'root_side', 'outside_root']) AS rule, unnest([count(*) FILTER (WHERE emitted > 900), count(*) FILTER (WHERE bytes > 12000), greatest(count(*) - 100, 0), count(*) FILTER (WHERE false),
  count(*) FILTER (WHERE min_x < -4000 OR max_x > 5500 OR min_y < -2000 OR max_y > 4000 OR min_z < 0 OR max_z > 100)]) AS found FROM tiles""", f"{tp._TREE}, {_TREE_TILES}")
def tile_warnings(spark, sf):
    """A root that is too small on one side, and limits that some nodes break."""
    tiles = tp._nodes(spark, sf).select(c("emitted").alias("n"), g.estimated_bytes(c("emitted")).alias("bytes"), *_SIDES)
    root = spark.createDataFrame([(-4000.0, -2000.0, 0.0, 5500.0, 4000.0, 100.0)], ", ".join(f"{s} double" for s in _SIDES))
    return rep.tile_warnings(tiles, root, 900, 12000, 100)
