"""Queries of the residual tree and what is rolled up from it; their twins unroll the levels as materialized views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodforge.functions import geometry as g
from lodforge.functions.hashing import INCREMENT, LAST, ROUNDS, SALT, with_stable_hash
from lodforge.operators import tree
from lodforge.operators.work import once, remembered
from lodforge.plans import registry as r

PROFILE = tree.Profile()
c = F.col
_WRAP = f"{1 << 64}::UHUGEINT"


def _hash_views() -> str:
    u = lambda n: f"{n}::UHUGEINT"
    views = [f"h0 AS (SELECT *, (xor(CAST(ordinal AS UHUGEINT), {u(SALT)}) + {u(INCREMENT)}) % {_WRAP} AS h FROM cells)"]
    for k, (shift, factor) in enumerate(ROUNDS):
        views.append(f"h{k + 1} AS (SELECT * REPLACE ((xor(h, h // {u(1 << shift)}) * {u(factor)}) % {_WRAP} AS h) FROM h{k})")
    views.append(f"hashed AS MATERIALIZED (SELECT * REPLACE (xor(h, h // {u(1 << LAST)}) AS h) FROM h{len(ROUNDS)})")
    return f"{r._CELLS}, " + ", ".join(views)


def _tree_views(p: tree.Profile) -> str:
    node, views = "ix,iy,path", ["c0 AS (SELECT ordinal, x, y, z, ix, iy, h, '' AS path, ix*2000.0::DOUBLE-4000 AS mx, iy*2000.0::DOUBLE-2000 AS my, 2000.0::DOUBLE AS size FROM hashed WHERE ordinal % 1000 <> 0)"]
    place = lambda a, low: f"least(greatest(CAST(trunc(({a}-{low})/size*{p.grid}) AS INT),0),{p.grid - 1})"
    for d in range(p.depth + 1):
        inner = "'internal'" if d < p.depth else f"CASE WHEN input <= {p.hard} THEN 'max-depth-leaf' ELSE 'overflow' END"
        views += [
            f"k{d} AS (SELECT *, count(*) OVER (PARTITION BY {node}) AS input FROM c{d})",
            f"m{d} AS MATERIALIZED (SELECT *, CASE WHEN input <= {p.leaf} THEN 'leaf' ELSE {inner} END AS kind, {place('y', 'my')}*{p.grid} + {place('x', 'mx')} AS cell FROM k{d})",
            f"q{d} AS {r.quota_sql(f'''(SELECT {node}, cell, count(*) AS cnt FROM m{d} WHERE kind = 'internal' GROUP BY ALL)''', node, p.target)}",
            f"r{d} AS MATERIALIZED (SELECT m.*, kind <> 'internal' OR row_number() OVER (PARTITION BY m.ix, m.iy, m.path, m.cell ORDER BY h, ordinal) <= alloc AS own FROM m{d} m LEFT JOIN q{d} USING ({node}, cell))",
            f"c{d + 1} AS (SELECT ordinal, x, y, z, ix, iy, h, concat(path, e + 2*n) AS path, mx + e*size/2 AS mx, my + n*size/2 AS my, size/2 AS size FROM (SELECT *, CAST(x >= mx+size/2 AS INT) AS e, CAST(y >= my+size/2 AS INT) AS n FROM r{d} WHERE NOT own))",
        ]
    owned = " UNION ALL ".join(f"SELECT ordinal, x, y, z, ix, iy, path, {d} AS depth, kind, input FROM r{d} WHERE own" for d in range(p.depth + 1))
    views += [
        f"owned AS MATERIALIZED ({owned})",
        "own_nodes AS (SELECT ix, iy, path, depth, kind, input, count(*) AS emitted, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, CASE WHEN depth > 0 THEN substr(path, 1, depth-1) END AS parent FROM owned GROUP BY ALL)",
        "nodes AS MATERIALIZED (SELECT a.*, coalesce(b.children, 0) AS children, coalesce(b.handed, 0) AS handed, kind <> 'internal' AND emitted < 200 AS underfilled FROM own_nodes a LEFT JOIN (SELECT ix, iy, parent AS path, count(*) AS children, CAST(sum(input) AS BIGINT) AS handed FROM own_nodes WHERE depth > 0 GROUP BY ALL) b USING (ix, iy, path))",
    ]
    return f"{_hash_views()}, " + ", ".join(views)


_HASH, _TREE = _hash_views(), _tree_views(PROFILE)


def _rollup_views(p: tree.Profile) -> str:
    raw = f"CASE WHEN kind = 'internal' THEN sqrt(greatest((max_x-min_x)*(max_y-min_y),1e-6)/greatest(1,emitted))*{p.scale} ELSE 0 END"
    sides = [f"{n}_{k}" for n in ("min", "max") for k in "xyz"]
    views = []
    for d in range(p.depth, -1, -1):
        folds = ", ".join(f"{s[:3]}(sub_{s}) AS c_{s}" for s in sides)
        none = ", ".join(f"0.0 AS c_{s}" for s in sides)
        child = f"(SELECT ix, iy, parent AS path, max(error) AS ce, {folds} FROM u{d + 1} GROUP BY ALL)" if d < p.depth else f"(SELECT 0 AS ix, 0 AS iy, '' AS path, 0.0 AS ce, {none} WHERE false)"
        own = ", ".join(f"{'least' if s.startswith('min') else 'greatest'}(n.{s}, b.c_{s}) AS sub_{s}" for s in sides)
        views.append(f"u{d} AS MATERIALIZED (SELECT n.ix, n.iy, n.path, n.depth, n.parent, n.kind, CASE WHEN kind = 'internal' THEN greatest({raw}, ce*1.05, ce+0.01) ELSE 0 END AS error, {own} FROM nodes n LEFT JOIN {child} b ON (n.ix, n.iy, n.path) = (b.ix, b.iy, b.path) WHERE n.depth = {d})")
    return f"{_TREE}, " + ", ".join(views)


def _hashed(spark, sf):
    return with_stable_hash(r._cells(spark, sf))


def _owned(spark, sf):
    """The tree of the data with the points' colours; its nodes and cuts are written once a session."""
    return remembered(spark, ("owned", sf), lambda: tree.residual_tree(_hashed(spark, sf).where("ordinal % 1000 <> 0"), PROFILE, keep=("red", "green", "blue")))


def _nodes(spark, sf):
    return once(spark, ("nodes", sf), lambda: tree.node_manifest(_owned(spark, sf)))


def on_owned(name: str, oracle: str, f) -> None:
    r.query(oracle, _TREE, name)(lambda spark, sf: f(_owned(spark, sf)))


def on_nodes(name: str, oracle: str, f) -> None:
    r.query(oracle, _TREE, name)(lambda spark, sf: f(_nodes(spark, sf)))


@r.query("SELECT ordinal, CAST(h // 4294967296 AS BIGINT) AS hi, CAST(h % 4294967296 AS BIGINT) AS lo FROM hashed", _HASH)
def stable_hash(spark, sf):
    return _hashed(spark, sf).select("ordinal", "hi", "lo")


@r.query(f"SELECT ordinal, ix, iy, cell FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy, cell ORDER BY h, ordinal) AS place FROM (SELECT *, {r._MICRO} AS cell FROM hashed)) JOIN {r._QUOTA} USING (ix, iy, cell) WHERE place <= alloc", _HASH)
def representatives(spark, sf):
    points = r._micro(_hashed(spark, sf))
    return tree.representatives(points, r._quota(points), ("ix", "iy")).where("own").select("ordinal", "ix", "iy", "cell")


on_owned("residual_tree", "SELECT ordinal, ix, iy, path, depth, kind FROM owned", lambda o: o.select("ordinal", "ix", "iy", "path", "depth", "kind"))
on_nodes("node_manifest", "SELECT ix, iy, path, parent, depth, kind, input, emitted, children, underfilled, round(min_x,6) AS min_x, round(max_y,6) AS max_y FROM nodes",
         lambda n: n.select("ix", "iy", "path", "parent", "depth", "kind", "input", "emitted", "children", "underfilled", r._r(c("min_x")).alias("min_x"), r._r(c("max_y")).alias("max_y")))
on_nodes("node_accounting", "SELECT ix, iy, path, kind, input, emitted, handed, input = emitted + handed AS balanced FROM nodes", tree.node_accounting)
on_nodes("ownership_by_depth", "SELECT depth, CAST(sum(emitted) AS BIGINT) AS emitted, CAST(coalesce(sum(emitted) FILTER (WHERE kind = 'internal'), 0) AS BIGINT) AS representative, CAST(sum(handed) AS BIGINT) AS residual FROM nodes GROUP BY ROLLUP(depth)",
         lambda n: n.rollup("depth").agg(F.sum("emitted").alias("emitted"), F.sum(F.when(c("kind") == "internal", c("emitted")).otherwise(0)).alias("representative"), F.sum("handed").alias("residual")))


@r.query("SELECT concat('d', depth) AS bucket, count(*) AS tiles, CAST(sum(emitted) AS BIGINT) AS points, CAST(sum(284 + emitted*15 + (8 - emitted*15 % 8) % 8) AS BIGINT) AS bytes FROM nodes GROUP BY 1 UNION ALL SELECT 'p001', count(*), CAST(sum(n) AS BIGINT), CAST(sum(284 + n*15 + (8 - n*15 % 8) % 8) AS BIGINT) FROM (SELECT count(*) AS n FROM cells WHERE ordinal % 1000 = 0 GROUP BY ix, iy)", _TREE)
def depth_summary(spark, sf):
    overview = r._cells(spark, sf).where("ordinal % 1000 = 0").groupBy("ix", "iy").agg(F.count("*").alias("emitted")).select(F.lit("p001").alias("bucket"), "emitted")
    tiles = _nodes(spark, sf).select(F.concat(F.lit("d"), c("depth").cast("string")).alias("bucket"), "emitted").unionByName(overview)
    return tiles.groupBy("bucket").agg(F.count("*").alias("tiles"), F.sum("emitted").alias("points"), F.sum(g.estimated_bytes(c("emitted"))).alias("bytes"))


_AREA = "(max_x-min_x)*(max_y-min_y)"
_FIGURES = {"points": "emitted", "extent": "greatest(max_x-min_x, max_y-min_y)", "density": f"emitted/greatest({_AREA}, 1.0)"}


@r.query("SELECT depth, count(*) AS leaves, " + ", ".join(f"round(quantile_cont({v},0.5),6) AS {k}_p50, round(quantile_cont({v},0.95),6) AS {k}_p95, round(max({v}),6) AS {k}_max" for k, v in _FIGURES.items())
         + f", count(*) FILTER (WHERE underfilled) AS underfilled, count(*) FILTER (WHERE {_AREA} < 1.0) AS clamped FROM nodes WHERE kind <> 'internal' GROUP BY ROLLUP(depth)", _TREE)
def leaf_diagnostics(spark, sf):
    rows = tree.leaf_diagnostics(_nodes(spark, sf), 1.0)
    return rows.withColumns({f"{k}_{q}": r._r(c(f"{k}_{q}")) for k in _FIGURES for q in ("p50", "p95", "max")})


_ROLLUP = _rollup_views(PROFILE)
_ALL = " UNION ALL ".join(f"SELECT * FROM u{d}" for d in range(PROFILE.depth + 1))


def _rolled(spark, sf):
    return once(spark, ("rolled", sf), lambda: tree.subtree_rollup(_nodes(spark, sf), PROFILE))


@r.query(f"SELECT ix, iy, path, kind, round(error,6) AS error, {', '.join(f'round(sub_{n}_{k},6) AS sub_{n}_{k}' for n in ('min', 'max') for k in 'xyz')} FROM ({_ALL})", _ROLLUP)
def subtree_rollup(spark, sf):
    return _rolled(spark, sf).select("ix", "iy", "path", "kind", *[r._r(c(k)).alias(k) for k in ("error", *[f"sub_{n}_{a}" for n in ("min", "max") for a in "xyz"])])


on_nodes("top_leaves", "SELECT ix, iy, path, emitted FROM nodes WHERE kind <> 'internal' ORDER BY emitted DESC, ix, iy, path LIMIT 10",
         lambda n: n.where("kind <> 'internal'").orderBy(F.desc("emitted"), "ix", "iy", "path").limit(10).select("ix", "iy", "path", "emitted"))
on_nodes("tile_lineage", "SELECT a.ix, a.iy, a.path, b.path AS below, b.depth - a.depth AS steps FROM nodes a JOIN nodes b ON a.ix = b.ix AND a.iy = b.iy AND starts_with(b.path, a.path)",
         lambda n: n.select("ix", "iy", c("path").alias("below"), F.explode(F.sequence(F.lit(0), c("depth"))).alias("_up"), "depth").select("ix", "iy", F.expr("substring(below, 1, _up)").alias("path"), "below", (c("depth") - c("_up")).alias("steps")))
on_nodes("descendants_by_level", "SELECT a.ix, a.iy, a.path, b.depth - a.depth AS steps, count(*) AS n FROM nodes a JOIN nodes b ON a.ix = b.ix AND a.iy = b.iy AND starts_with(b.path, a.path) AND b.depth > a.depth GROUP BY ALL",
         lambda n: n.select("ix", "iy", "path", "depth", F.explode(F.sequence(F.lit(0), c("depth"))).alias("_up")).where("_up < depth").groupBy("ix", "iy", F.expr("substring(path, 1, _up)").alias("path"), (c("depth") - c("_up")).alias("steps")).agg(F.count("*").alias("n")))
