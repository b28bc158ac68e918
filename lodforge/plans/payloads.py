"""Queries of payloads, documents, files and chunk streams. What SQL can state of their content has a twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodforge.functions import geometry as g
from lodforge.functions import text as t
from lodforge.operators import documents
from lodforge.operators.work import folder, once
from lodforge.plans import registry as r
from lodforge.plans import tree as tp
from lodforge.plans.pyramids import _REPORTS, reports
from lodforge.sources import files, filetree, ranges
from lodforge.sources import payloads as pay
from lodforge.sources import points as src
from lodforge.streaming import chunks as ch

c = F.col
_URI = "concat('points/adaptive/', printf('z0_x%06d_y%06d', ix, iy), '/d', depth, '_q', path, '.pnts')"


def _uri():
    return F.concat(F.lit("points/adaptive/"), g.tile_id(0, c("ix"), c("iy")), F.lit("/d"), c("depth").cast("string"), F.lit("_q"), "path", F.lit(".pnts"))


def _payloads(spark, sf):
    """Payloads of every node of the tree, with colours, written once a session."""

    def build():
        colours = [g.rgb_to_u8(c(k)).alias(k) for k in ("red", "green", "blue")]
        encoded = pay.encode_pnts(tp._owned(spark, sf).select("ix", "iy", "path", "ordinal", "x", "y", "z", *colours), ("ix", "iy", "path"))
        return encoded.withColumn("depth", F.length("path")).select(_uri().alias("uri"), "payload", "bytes")

    return once(spark, ("payloads", sf), build)


@r.query(f"SELECT {_URI} AS uri, emitted AS points FROM nodes", tp._TREE)
def pnts_encode(spark, sf):
    return pay.read_pnts_headers(_payloads(spark, sf)).where("magic = 'pnts' and byte_length = stored").select("uri", "points")


def _files(spark, rows, **more):
    """Rows written as files, and those files as Spark lists them, with ``uri`` under the root."""
    root = f"{folder(spark)}/files"
    filetree.write_files(rows, root, **more)
    return ranges.every_file(spark, root, recursive=True).withColumn("uri", F.regexp_extract("path", r"/files/(.*)$", 1))


@r.query(f"SELECT {_URI} AS uri, emitted AS points, true AS whole FROM nodes", tp._TREE)
def pnts_sink(spark, sf):
    """Payloads written as files; each file's header is read back and held against the file's size."""
    heads = ranges.file_headers(_files(spark, _payloads(spark, sf)))
    return heads.select("uri", "points", (c("byte_length") == c("size")).alias("whole"))


@r.query(f"SELECT {_URI} AS uri, emitted AS points, round((min_x+max_x)/2, 6) AS cx, true AS has_rgb, true AS bounded FROM nodes", tp._TREE)
def pnts_headers(spark, sf):
    """Headers of files of which only header and feature table are read."""
    heads = ranges.file_headers(_files(spark, _payloads(spark, sf)))
    return heads.select("uri", "points", r._r(F.element_at("center", 1)).alias("cx"), "has_rgb", (c("bytes_read") <= 400).alias("bounded"))


@r.query("SELECT uri, place, red, green, blue FROM (SELECT " + _URI + " AS uri, row_number() OVER (PARTITION BY ix, iy, path ORDER BY ordinal) - 1 AS place, " + ", ".join(f"CAST(floor(least(greatest({k}/256,0),255)) AS INT) AS {k}" for k in ("red", "green", "blue")) + " FROM owned JOIN (SELECT ordinal, red, green, blue FROM cells) USING (ordinal))", tp._TREE)
def pnts_points(spark, sf):
    """Positions are single precision from the centre; tests hold them against the points."""
    return pay.read_pnts_points(_payloads(spark, sf)).select("uri", "place", "red", "green", "blue")


@r.query(f"SELECT {_URI} AS uri, CASE WHEN right(path, 1) = '3' THEN 'missing' ELSE 'points' END AS problem FROM nodes WHERE right(path, 1) IN ('2', '3')", tp._TREE)
def pnts_valid(spark, sf):
    """Some payloads are missing, others expected with one point more."""
    last = F.right("path", F.lit(1))
    expected = tp._nodes(spark, sf).select(_uri().alias("uri"), (c("emitted") + (last == "2").cast("int")).alias("points"), F.lit(True).alias("has_rgb"))
    return pay.validate_pnts(pay.read_pnts_headers(_payloads(spark, sf).where(~c("uri").rlike(r"3\.pnts$"))), expected)


def _documents(spark, sf, diagnostics: bool = True):
    n = tp._rolled(spark, sf)
    box = g.box(*[tuple(c(f"sub_{s}_{k}") for k in "xyz") for s in ("min", "max")])
    extras = F.to_json(F.struct("kind", "input", "emitted"))
    rows = n.select(g.tile_id(0, c("ix"), c("iy")).alias("doc"), "path", "parent", "error", box.alias("box"), _uri().alias("uri"), extras.alias("extras"))
    return pay.tile_documents(rows, "doc", diagnostics)


ENTRY = "tileset.json"
_DOC = "concat('z0/', printf('z0_x%06d_y%06d', ix, iy), '/tileset.json')"
_GONE, _CUT = "ix % 5 = 1", "ix % 5 <> 1 AND iy % 7 = 2"


def _linked(spark, sf):
    """Cell documents by uri, with contents as seen from there, and the entry that refers to all of them."""
    n = tp._rolled(spark, sf)
    box = g.box(*[tuple(c(f"sub_{s}_{k}") for k in "xyz") for s in ("min", "max")])
    doc = F.concat(F.lit("z0/"), g.tile_id(0, c("ix"), c("iy")), F.lit("/tileset.json"))
    rows = n.select(doc.alias("doc"), "path", "parent", "error", box.alias("box"), t.rebase_uri(_uri(), F.lit(""), F.regexp_replace(doc, "/[^/]*$", "")).alias("uri"))
    cells = pay.tile_documents(rows, "doc").select(c("doc").alias("uri"), "json")
    volume = F.struct(F.array([F.lit(float(v)) for v in (0, 0, 0, 1e5, 0, 0, 0, 1e5, 0, 0, 0, 1e5)]).alias("box")).alias("boundingVolume")
    child = lambda uri: F.struct(volume, F.lit(1e9).alias("geometricError"), F.struct(uri.alias("uri")).alias("content"))
    uris = n.select(doc.alias("uri")).distinct().agg(F.array_sort(F.collect_list("uri")).alias("uris"))  # one reference a root cell
    root = F.struct(volume, F.lit(1e9).alias("geometricError"), F.lit("ADD").alias("refine"), F.transform("uris", child).alias("children"))
    entry = uris.select(F.lit(ENTRY).alias("uri"), F.to_json(F.struct(F.struct(F.lit("1.1").alias("version")).alias("asset"), F.lit(1e9).alias("geometricError"), root.alias("root"))).alias("json"))
    return cells.unionByName(entry)


@r.query(f"SELECT {_DOC} AS uri, count(*) AS tiles, CAST(0 AS BIGINT) AS problems FROM ({tp._ALL}) GROUP BY ix, iy UNION ALL SELECT '{ENTRY}', 1 + count(DISTINCT (ix, iy)), 0 FROM nodes", tp._ROLLUP)
def tile_docs_sink(spark, sf):
    """Documents written as files, the entry moved last, and read back as a viewer would."""
    listed = _files(spark, _linked(spark, sf).select("uri", c("json").cast("binary").alias("payload")), last=ENTRY)
    texts = spark.read.format("binaryFile").load(listed.select(F.regexp_extract("path", "^(.*/files)/", 1)).first()[0], recursiveFileLookup=True)
    docs = texts.select(F.regexp_extract("path", r"/files/(.*)$", 1).alias("uri"), c("content").cast("string").alias("json"))
    tiles = pay.read_tile_documents(docs.withColumnRenamed("uri", "doc"))
    return tiles.groupBy(c("doc").alias("uri")).agg(F.count("*").alias("tiles"), F.count("problem").alias("problems"))


@r.query(f"""SELECT {_DOC} AS doc, 1 AS steps, CAST(depth AS INT) AS depth, {_URI} AS target, round(error, 6) AS error, NULL AS problem FROM ({tp._ALL}) WHERE NOT ({_GONE}) AND NOT ({_CUT})
  UNION ALL SELECT DISTINCT {_DOC}, 1, NULL, NULL, NULL, 'broken' FROM nodes WHERE {_CUT}
  UNION ALL SELECT '{ENTRY}', 0, 0, NULL, 1e9, NULL UNION ALL SELECT DISTINCT '{ENTRY}', 0, 1, {_DOC}, 1e9, CASE WHEN {_GONE} THEN 'missing' END FROM nodes""", tp._ROLLUP)
def tile_docs_source(spark, sf):
    """From the entry through all documents; some are missing, some texts are cut off."""
    cell = [F.regexp_extract("uri", pattern, 1).try_cast("int") for pattern in (r"_x(\d+)", r"_y(\d+)")]
    docs = _linked(spark, sf).withColumns({"ix": cell[0], "iy": cell[1]})
    docs = docs.where(f"uri = '{ENTRY}' OR NOT ({_GONE})").withColumn("json", F.when(F.coalesce(F.expr(_CUT), F.lit(False)), F.substring("json", 1, 40)).otherwise(c("json")))
    return documents.resolve_documents(docs, ENTRY).select("doc", "steps", "depth", "target", r._r(c("error")).alias("error"), "problem")


@r.query("SELECT printf('z0_x%06d_y%06d', ix, iy) AS doc, count(*) AS entries FROM nodes GROUP BY ix, iy", tp._TREE)
def metadata_map_sink(spark, sf):
    rows = tp._nodes(spark, sf).select(g.tile_id(0, c("ix"), c("iy")).alias("doc"), _uri().alias("uri"), F.struct("kind", "input", "emitted", "underfilled").alias("diag"))
    maps = pay.metadata_maps(rows)
    path = f"{folder(spark)}/maps"
    maps.write.parquet(path)
    return spark.read.parquet(path).select("doc", "entries")


@r.query("SELECT printf('z0_x%06d_y%06d', ix, iy) AS doc, CAST(sum(length(concat(',\"extras\":{\"kind\":\"', kind, '\",\"input\":', input, ',\"emitted\":', emitted, '}'))) AS BIGINT) AS delta FROM nodes GROUP BY ix, iy", tp._TREE)
def metadata_byte_delta(spark, sf):
    size = lambda with_: _documents(spark, sf, with_).select("doc", F.octet_length("json").alias(f"b{int(with_)}"))
    return size(True).join(size(False), "doc").select("doc", (c("b1") - c("b0")).cast("long").alias("delta"))


@r.query(f"SELECT {_URI} AS uri, 'first' AS side FROM nodes WHERE right(path, 1) = '3' UNION ALL SELECT concat('new/', {_URI}), 'second' FROM nodes WHERE right(path, 1) = '1'", tp._TREE)
def variant_parity(spark, sf):
    """Documents with and without diagnostics refer to the same contents; the second variant then loses some and gains others."""
    first, second = (pay.read_tile_documents(_documents(spark, sf, with_)) for with_ in (True, False))
    kept, more = F.when(~c("uri").rlike(r"3\.pnts$"), c("uri")), F.when(c("uri").rlike(r"1\.pnts$"), F.concat(F.lit("new/"), "uri"))
    changed = second.select(F.explode(F.array_compact(F.array(kept, more))).alias("uri"))
    return pay.variant_parity(first, changed)


@r.query("SELECT chunk_id, source_points, emitted_points, crs FROM reports", _REPORTS)
def report_source(spark, sf):
    """Reports written as JSON, one folder a chunk, and read back."""
    path = f"{folder(spark)}/reports"
    rows = reports(spark, sf).select(c("chunk_id").alias("folder"), "chunk_id", "source_points", "emitted_points", "crs")
    rows.repartition("folder").write.partitionBy("folder").json(path)
    found = files.read_reports(spark, f"{path}/*/*.json", "source_points long, emitted_points long, crs string")
    return found.withColumn("chunk_id", F.regexp_replace("chunk_id", "^folder=", ""))


_TABLES = "/{lineitem,events}*.parquet"
#: Folders of written texts, so that tasks share their listing.
FOLDERS = 1024


@r.query("""SELECT name, size, sha256, bytes_read, sha256(concat('[', string_agg(concat('{"name":"', name, '","size":', size, ',"sha256":"', sha256, '"}'), ',' ORDER BY name) OVER (), ']')) AS dataset, substr(sha256(concat('[', string_agg(concat('{"name":"', name, '","size":', size, ',"sha256":"', sha256, '"}'), ',' ORDER BY name) OVER (), ']')), 1, 16) AS salt
  FROM (SELECT concat(doc_id, '.txt') AS name, CAST(strlen(body) AS BIGINT) AS size, sha256(substr(body, 1, 1048576)) AS sha256, least(CAST(strlen(body) AS BIGINT), 1048576) AS bytes_read FROM (SELECT doc_id, repeat(coalesce(text, ''), CASE WHEN doc_id = 0 THEN 4000 ELSE 1 END) AS body FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM documents)))""", "none AS (SELECT 1)")
def source_fingerprint(spark, sf):
    """Texts written as files in folders by a hash, one of them far over a MiB, of which only the first MiB is read."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "?")
    body = F.when(c("doc_id") == 0, F.repeat(text, F.lit(4000))).otherwise(text)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDERS)), F.lit("/"), "doc_id", F.lit(".txt")).alias("uri"), body.cast("binary").alias("payload"))
    root = f"{folder(spark)}/files"
    filetree.write_files(rows, root)
    return files.fingerprints(spark, root, recursive=True).drop("modified")


@r.query(None)
def source_metrics(spark, sf):
    metadata = '{"name": "CH1903+ / LV95"}'
    return files.source_metrics(spark, sf + _TABLES, src.plain_points(spark, sf).columns, metadata)


@r.query("SELECT sha256(concat('{', string_agg(concat('\"', chunk_id, '\":', n), ',' ORDER BY chunk_id), '}')) AS hash FROM (SELECT chunk_id, count(*) AS n FROM points GROUP BY 1)")
def profile_hash(spark, sf):
    counts = src.plain_points(spark, sf).groupBy("chunk_id").agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "n"))).alias("profile")).select(files.profile_hash(c("profile")).alias("hash"))


r.on_timing("uri_rebase", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('../b/', uri) WHEN 1 THEN concat('../../', uri) ELSE concat('https://t/', uri) END AS rebased FROM timing",
            lambda e: e.select("event_id", t.rebase_uri(F.when(c("event_id") % 3 == 0, c("uri")).when(c("event_id") % 3 == 1, F.concat(F.lit("./../../"), "uri")).otherwise(F.concat(F.lit("https://t/"), "uri")), F.lit("a/b"), F.lit("a/c")).alias("rebased")))


@r.query("SELECT CAST(l_returnflag AS VARCHAR) AS chunk_id, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY l_returnflag) - count(*) AS BIGINT) AS first FROM lineitem GROUP BY l_returnflag", r._POINTS)
def incremental_chunks(spark, sf):
    schema = spark.read.parquet(f"{sf}/lineitem.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/lineitem*.parquet").select(c("l_returnflag").alias("chunk_id"), "l_orderkey")
    return ch.stream_chunks(rows, f"{folder(spark)}/stream").select("chunk_id", "n", "first")


@r.query("SELECT ix, iy, count(*) AS rows, CASE WHEN ix < 2 THEN 1 ELSE 2 END AS run FROM (SELECT DISTINCT ix, iy, floor(x/500), floor(y/500) FROM cells) GROUP BY 1,2", r._CELLS)
def cell_finalize(spark, sf):
    """Two runs: the second one finds the first one's cells done."""
    p, place = r._plain_cells(spark, sf), f"{folder(spark)}/finalized"
    build = lambda rows: rows.groupBy("ix", "iy", F.floor(c("x") / 500).alias("u"), F.floor(c("y") / 500).alias("v")).agg(F.count("*").alias("n"))
    ch.finalize_cells(p.where("ix < 2"), build, place)
    return ch.finalize_cells(p, build, place)
