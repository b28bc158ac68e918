"""Queries of sources, chunks, censuses and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodforge.functions import geometry as g
from lodforge.functions import text as t
from lodforge.operators import audit, chunks
from lodforge.operators.work import folder, once
from lodforge.plans import registry as r
from lodforge.sources import points as src

c = F.col
NAMES = [f"chunk-{k}" for k in range(8)]


@r.query("SELECT count(*) AS n, round(min(x),6) AS min_x, round(max(x),6) AS max_x, round(min(y),6) AS min_y, round(max(y),6) AS max_y, round(min(z),6) AS min_z, round(max(z),6) AS max_z, false AS has_rgb, 'LV95' AS crs, true AS one_crs FROM points")
def point_scan(spark, sf):
    """Eight chunk sources in one system, one of them without colours."""
    rows = src.plain_points(spark, sf).withColumn("crs", F.lit("LV95"))
    parts = [rows.where(c("chunk_id") == n).drop("chunk_id", *(("red", "green", "blue") if n == "chunk-6" else ())) for n in NAMES]
    meta = src.read_points(parts, NAMES)[1]
    return meta.select("n", *[r._r(c(f"{n}_{k}")).alias(f"{n}_{k}") for k in "xyz" for n in ("min", "max")], "has_rgb", "crs", "one_crs")


@r.query("SELECT ordinal, round(x,6) AS x, CASE WHEN chunk_id <> 'chunk-6' THEN red END AS red FROM points")
def consolidate_sources(spark, sf):
    rows = src.points(spark, sf).select("ordinal", r._r(c("x")).alias("x"), "red", "chunk_id")
    return chunks.consolidate([rows.where(c("chunk_id") == n).drop("chunk_id", *(("red",) if n == "chunk-6" else ())) for n in NAMES])


@r.query("SELECT CAST(floor((x+4000)/500) AS INT) AS cx, CAST(floor((y+2000)/500) AS INT) AS cy, count(*) AS n, round(min(x),6) AS min_x FROM cells GROUP BY 1,2", r._CELLS)
def spatial_chunk(spark, sf):
    """Squares written as folders and read back."""
    path = f"{folder(spark)}/squares"
    chunks.write_chunks(chunks.spatial_chunk(r._plain_cells(spark, sf), 500.0, (-4000.0, -2000.0)), path)
    return spark.read.parquet(path).groupBy("cx", "cy").agg(F.count("*").alias("n"), r._r(F.min("x")).alias("min_x"))


@r.query("SELECT chunk_id, count(*) AS n, round(sum(z), 3) AS z, true AS skipped FROM points WHERE x BETWEEN 5300 AND 5500 AND y BETWEEN 0 AND 100 GROUP BY 1")
def box_read(spark, sf):
    """Points of a box from files along a space-filling curve; only files whose bounds meet it are read."""
    path = f"{folder(spark)}/curve"
    files = chunks.write_along_curve(src.plain_points(spark, sf), path, 5000).count()
    rows, read = chunks.read_box(spark, path, (5300.0, 0.0), (5500.0, 100.0))
    return rows.groupBy("chunk_id").agg(F.count("*").alias("n"), r._r(F.sum("z"), 3).alias("z")).withColumn("skipped", F.lit(2 * read < files))


@r.query("""SELECT ordinal, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, cx <> floor((x+4000)/500) OR cy <> floor((y+2000)/500) AS is_buffer FROM (SELECT ordinal, x, y, unnest(range(CAST(floor((x-20+4000)/500) AS BIGINT), CAST(floor((x+20+4000)/500) AS BIGINT)+1)) AS cx,
  floor((y-20+2000)/500) AS y0, floor((y+20+2000)/500) AS y1 FROM cells) a, (SELECT CAST(range AS BIGINT) AS cy FROM range(-20, 40)) b WHERE cy BETWEEN y0 AND y1""", r._CELLS)
def spatial_chunk_buffered(spark, sf):
    return chunks.spatial_chunk(src.points(spark, sf), 500.0, (-4000.0, -2000.0), 20.0).select("ordinal", "cx", "cy", "is_buffer")


@r.query("SELECT ordinal, round(x,6) AS x, chunk_id FROM points")
def global_ordinal(spark, sf):
    return src.points(spark, sf, fresh=True).select("ordinal", r._r(c("x")).alias("x"), "chunk_id")


def _by_chunk(spark, sf):
    """Points by folders of their chunk and the chunks' bounds, written once a session."""

    def build():
        path = f"{folder(spark)}/by-chunk"
        src.plain_points(spark, sf).write.partitionBy("chunk_id").parquet(path)
        return chunks.chunk_stats(spark.read.parquet(path)).withColumn("path", F.lit(path))

    stats = once(spark, ("chunk-stats", sf), build)
    return spark.read.parquet(stats.first()["path"]), stats


@r.query("SELECT chunk_id, count(*) AS n FROM points GROUP BY 1 HAVING max(x) >= 5300 AND min(x) <= 5500 AND max(y) >= 0 AND min(y) <= 100")
def chunk_prune(spark, sf):
    """Only the folders of chunks that meet the box are read: the few names join as a filter on partitions."""
    rows, stats = _by_chunk(spark, sf)
    hits = chunks.prune(stats, spark.createDataFrame([(5300.0, 0.0, 5500.0, 100.0)], "low_x double, low_y double, high_x double, high_y double"))
    return rows.join(F.broadcast(hits), "chunk_id").groupBy("chunk_id").agg(F.count("*").alias("n"))


r.on_ordinals("decimate_step", "SELECT chunk_id, ix, iy, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, ix, iy ORDER BY ordinal) - 1 AS s FROM cells) WHERE s % 10 = 0",
            lambda p: chunks.decimate(p, 10, ("chunk_id", "ix", "iy")).select("chunk_id", "ix", "iy", "ordinal"))

_INVALID = "faulty AS (SELECT * REPLACE (CASE WHEN red % 1024 = 0 THEN NULL ELSE z END AS z) FROM cells)"


def _faulty(spark, sf):
    """Points of which some have no height."""
    return r._plain_cells(spark, sf).withColumn("z", F.when(c("red") % 1024 != 0, c("z")))


@r.query("SELECT ix, iy, printf('z0_x%06d_y%06d', ix, iy) AS z0_id, count(*) AS n, (SELECT count(*) FROM faulty) AS visited, (SELECT count(*) FROM faulty WHERE z IS NULL) AS invalid FROM faulty WHERE z IS NOT NULL GROUP BY 1,2", f"{r._CELLS}, {_INVALID}")
def z0_census(spark, sf):
    return audit.z0_census(_faulty(spark, sf)).withColumn("z0_id", g.tile_id(0, c("ix"), c("iy")))


@r.query("SELECT count(*) AS visited, count(*) FILTER (WHERE z IS NULL) AS invalid, count(*) FILTER (WHERE z IS NOT NULL AND ix < 1) AS outside, count(*) FILTER (WHERE z IS NOT NULL AND ix >= 1) AS eligible, true AS balanced FROM faulty", f"{r._CELLS}, {_INVALID}")
def accounting_totals(spark, sf):
    ok = audit.valid("x", "y", "z")
    rows = _faulty(spark, sf).agg(F.count("*").alias("visited"), F.count_if(~ok).alias("invalid"), F.count_if(ok & (c("ix") < 1)).alias("outside"), F.count_if(ok & (c("ix") >= 1)).alias("eligible"))
    return rows.withColumn("balanced", c("visited") == c("invalid") + c("outside") + c("eligible"))


_OWNED = """expected AS (SELECT ordinal, ix, iy, CASE WHEN ordinal % 1000 = 0 THEN 'p001' ELSE 'adaptive' END AS role, x, y FROM cells),
  kept AS (SELECT * FROM expected WHERE ordinal % 1013 <> 7), owned AS (SELECT ordinal, CASE WHEN ordinal % 1009 = 3 THEN ix + 1 ELSE ix END AS ix, iy, CASE WHEN ordinal % 997 = 2 THEN 'p001' ELSE role END AS role, x, y FROM kept
  UNION ALL SELECT * FROM expected WHERE ordinal % 1021 = 5 UNION ALL SELECT ordinal + 1000000000, ix, iy, role, x, y FROM expected WHERE ordinal % 1019 = 4)"""
_AUDIT = """one AS (SELECT coalesce(e.ordinal, o.ordinal) AS ordinal, e.ix AS ex, e.iy AS ey, coalesce(e.ix, o.ix) AS ix, coalesce(e.iy, o.iy) AS iy, e.role AS e_role, o.* EXCLUDE (ordinal, ix, iy) FROM expected e FULL JOIN
  (SELECT ordinal, count(*) AS m, min(ix) AS ix, min(iy) AS iy, max(ix) AS hx, min(role) AS lr, max(role) AS hr, bool_or(NOT (x BETWEEN ix*2000-4000 AND ix*2000-2000 AND y BETWEEN iy*2000-2000 AND iy*2000)) AS away, min(ix) AS lx FROM owned GROUP BY 1) o ON e.ordinal = o.ordinal)"""


@r.query("SELECT ix, iy, count(*) FILTER (WHERE m > 1) AS duplicates, count(*) FILTER (WHERE m IS NULL) AS omitted, count(*) FILTER (WHERE ex IS NULL) AS extra, count(*) FILTER (WHERE lx <> ex OR hx <> ex) AS wrong_owner, count(*) FILTER (WHERE lr <> e_role OR hr <> e_role) AS wrong_role, count(*) FILTER (WHERE away) AS out_of_range FROM one GROUP BY 1,2", f"{r._CELLS}, {_OWNED}, {_AUDIT}")
def ownership_audit(spark, sf):
    """Points that were dropped, doubled, invented, given to a neighbour or to the other role."""
    expected = r._cells(spark, sf).select("ordinal", "ix", "iy", g.role(c("ordinal")).alias("role"), "x", "y")
    kept = expected.where("ordinal % 1013 <> 7").withColumns({"ix": F.when(c("ordinal") % 1009 == 3, c("ix") + 1).otherwise(c("ix")), "role": F.when(c("ordinal") % 997 == 2, "p001").otherwise(c("role"))})
    owned = kept.unionAll(expected.where("ordinal % 1021 = 5")).unionAll(expected.where("ordinal % 1019 = 4").withColumn("ordinal", c("ordinal") + 1000000000))
    return audit.audit(expected, owned, g.CELL, (-4000.0, -2000.0))


@r.query("SELECT (SELECT count(*) FROM cells WHERE ordinal % 1013 = 7) AS missing, (SELECT count(*) FROM cells WHERE ordinal % 1013 <> 7 AND ordinal % 1021 = 5) AS surplus FROM (SELECT 1)", r._CELLS)
def role_complete(spark, sf):
    p = src.points(spark, sf).select("ordinal")
    kept = p.where("ordinal % 1013 <> 7")
    return audit.role_gap(p, kept.unionAll(kept.where("ordinal % 1021 = 5")))


_LEDGER = "SELECT chunk_id, count(*) AS n, max(z) AS top, row_number() OVER (ORDER BY chunk_id) AS place FROM cells WHERE {} GROUP BY 1"


_OLD, _NEW = "chunk_id <> 'chunk-7'", "chunk_id <> 'chunk-1' AND (chunk_id <> 'chunk-3' OR red > 100)"


@r.query(f"SELECT chunk_id, CASE WHEN o.n IS NULL THEN 'added' WHEN w.n IS NULL THEN 'removed' WHEN o.n <> w.n OR o.top <> w.top THEN 'changed' WHEN o.place <> w.place THEN 'reordered' ELSE 'same' END AS status FROM ({_LEDGER.format(_OLD)}) o FULL JOIN ({_LEDGER.format(_NEW)}) w USING (chunk_id)", r._CELLS)
def source_drift(spark, sf):
    def ledger(condition):
        rows = r._plain_cells(spark, sf).where(condition).groupBy("chunk_id").agg(F.count("*").alias("n"), F.max("z").alias("top"))
        return rows.withColumn("place", F.row_number().over(Window.orderBy("chunk_id")))  # one row a source

    return audit.source_drift(ledger(_OLD), ledger(_NEW), "chunk_id", ["n", "top"], "place")


_PILOT = f"(SELECT ix, iy FROM {r._CENSUS} ORDER BY n DESC, ix, iy LIMIT 1) UNION (SELECT ix, iy FROM {r._CENSUS} ORDER BY abs(n - (SELECT quantile_cont(n,0.25) FROM {r._CENSUS})), ix, iy LIMIT 1)"


@r.query(f"SELECT ix, iy, n, 0 AS unknown FROM {r._CENSUS} WHERE (ix, iy) NOT IN (SELECT (ix, iy) FROM ({_PILOT}))", r._CELLS)
def pilot_extension(spark, sf):
    from lodforge.plans import ledgers

    p = r._plain_cells(spark, sf)
    return audit.extension_cells(ledgers._census(p), ledgers._pilot(p))


@r.query("SELECT count(*) FILTER (WHERE ix > 0 AND ordinal % 1000 = 0) AS p001, count(*) FILTER (WHERE ix > 0 AND ordinal % 1000 <> 0) AS adaptive, count(*) AS visited, 0 AS invalid, count(*) FILTER (WHERE ix <= 0) AS outside FROM cells", r._CELLS)
def extension_accounting(spark, sf):
    p = r._cells(spark, sf)
    account = lambda condition: p.where(condition).groupBy("ix", "iy").agg(F.count_if(c("ordinal") % 1000 == 0).alias("p001"), F.count_if(c("ordinal") % 1000 != 0).alias("adaptive"))
    return audit.merge_extension(account("ix = 1 and iy = 0"), account("ix > 0 and not (ix = 1 and iy = 0)"), audit.z0_census(p)).withColumn("invalid", c("invalid").cast("int"))


# Display text: values of every magnitude, by stretching the sizes of requests
_WIDE = "(SELECT event_id, CASE event_id % 5 WHEN 0 THEN decoded ELSE decoded * CAST(1000 ** (event_id % 5) AS BIGINT) END AS n FROM timing)"


def _wide(e):
    return e.select("event_id", (c("decoded") * F.pow(F.lit(1000.0), c("event_id") % 5).cast("long")).alias("n"))


r.on_timing("human_bytes", "SELECT event_id, CASE WHEN n < 1024 THEN concat(n, ' B')" + "".join(f" WHEN n < {1024 ** (k + 1)} THEN concat(printf('%.1f', round(n/{1024 ** k}.0::DOUBLE,1)), ' {u}')" for k, u in ((1, "KiB"), (2, "MiB"), (3, "GiB"))) + f" ELSE concat(printf('%.1f', round(n/{1024 ** 4}.0::DOUBLE,1)), ' TiB') END AS label FROM {_WIDE}",
            lambda e: _wide(e).select("event_id", t.human_bytes(c("n")).alias("label")))
r.on_timing("human_count", "SELECT event_id, CASE" + "".join(f" WHEN n >= {10 ** k} THEN concat(printf('%.1f', round(n/{10 ** k}.0::DOUBLE,1)), '{u}')" for k, u in ((9, "B"), (6, "M"), (3, "K"))) + f" ELSE CAST(n AS VARCHAR) END AS label FROM {_WIDE}",
            lambda e: _wide(e).select("event_id", t.human_count(c("n")).alias("label")))
r.on_timing("uri_canonical", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('/x/', uri) WHEN 1 THEN concat('relative:../', uri) WHEN 2 THEN uri WHEN 3 THEN uri WHEN 4 THEN uri ELSE concat('a/', uri) END AS canonical FROM timing""",
            lambda e: e.select("event_id", t.canonical_uri(_spelled(c("event_id") % 6, c("uri"))).alias("canonical")))


def _spelled(k, uri):
    """One reference in six spellings."""
    forms = (("https://t/x/", "?c=1"), ("../", "#a"), ("/", ""), ("./", "?q"))
    out = F.when(k == 4, F.translate(uri, "/", "\\")).otherwise(F.concat(F.lit("a\\"), F.translate(uri, "/", "\\")))
    for i, (a, b) in enumerate(forms):
        out = F.when(k == i, F.concat(F.lit(a), uri, F.lit(b))).otherwise(out)
    return out
