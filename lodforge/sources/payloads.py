"""Point payloads and tile documents as rows: encoded, read back, checked.

A payload is the public point-cloud tile format: a 28-byte header, a JSON feature table, float positions from a centre, maybe
colours, both tables padded to 8 bytes. Payloads and documents are rows keyed by uri until ``filetree`` writes them as files; the bytes in a row are those of the file. Readers
take any bytes and any text: what isn't sound becomes a row with nulls or a ``problem``.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = struct.Struct("<4s6I")
MAGIC, VERSION = b"pnts", 1
#: Bytes that no sound feature table of these payloads comes near; one said to be larger isn't read.
TABLE = 1 << 24
_HEADERS = "uri string, magic string, version int, byte_length long, stored long, points long, center array<double>, has_rgb boolean"


def _padded(raw: bytes, fill: bytes, before: int = 0) -> bytes:
    return raw + fill * (-(len(raw) + before) % 8)


def encode_payload(xyz: np.ndarray, rgb: np.ndarray | None) -> bytes:
    """One node's payload; positions are stored from the middle of their bounds in single precision."""
    center = (xyz.min(0) + xyz.max(0)) / 2 if len(xyz) else np.zeros(3)
    table = {"POINTS_LENGTH": len(xyz), "RTC_CENTER": center.tolist(), "POSITION": {"byteOffset": 0}}
    body = (xyz - center).astype("<f4").tobytes()
    if rgb is not None:
        table["RGB"] = {"byteOffset": len(body)}
        body += rgb.astype(np.uint8).tobytes()
    head, body = _padded(json.dumps(table, separators=(",", ":")).encode(), b" ", HEADER.size), _padded(body, b"\0")
    return HEADER.pack(MAGIC, VERSION, HEADER.size + len(head) + len(body), len(head), len(body), 0, 0) + head + body


def encode_pnts(points: DataFrame, node: tuple[str, ...] = ("uri",)) -> DataFrame:
    """``node``, ``payload``, ``bytes`` of each node of points (the columns ``node``, ordinal, x, y, z and maybe red, green, blue from 0 to 255).

    A group is a node, so the tree's hard limit bounds it. Points go in ordinal order. Null colours count as 0. Points are shuffled with
    their node, so a short key costs less than a uri; a point's colours go as one number.
    """
    coloured = {"red", "green", "blue"} <= set(points.columns)
    byte = lambda k: F.coalesce(F.col(k).cast("int"), F.lit(0)).bitwiseAND(F.lit(255))
    rgb = [(byte("red") * 65536 + byte("green") * 256 + byte("blue")).alias("_rgb")] if coloured else []

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        rgb = (rows["_rgb"].to_numpy()[:, None] >> np.array([16, 8, 0])) & 255 if coloured else None
        raw = encode_payload(rows[["x", "y", "z"]].to_numpy(np.float64), rgb)
        return pd.DataFrame([(*key, raw, len(raw))], columns=[*node, "payload", "bytes"])

    columns = ", ".join(f"`{n}` {t}" for n, t in points.select(*node).dtypes)
    return points.select(*node, "ordinal", "x", "y", "z", *rgb).groupBy(*node).applyInPandas(one, f"{columns}, payload binary, bytes long")


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and np.isfinite(value)


def feature_table(raw: bytes) -> dict:
    """A feature table's known entries, without those of a wrong type."""
    try:
        table = json.loads(raw)
    except ValueError:
        return {}
    if not isinstance(table, dict):
        return {}
    count = lambda v: isinstance(v, int) and not isinstance(v, bool) and 0 <= v < 1 << 32
    offset = lambda v: isinstance(v, dict) and count(v.get("byteOffset"))
    sound = {"POINTS_LENGTH": count, "RTC_CENTER": lambda v: isinstance(v, list) and len(v) == 3 and all(map(_number, v)), "POSITION": offset, "RGB": offset}
    return {k: v for k, v in table.items() if k in sound and sound[k](v)}


def _parse(raw: bytes | None) -> tuple:
    """(magic, version, byteLength, feature table, offset of the body); Nones for what isn't there."""
    if raw is None or len(raw) < HEADER.size:
        return None, None, None, {}, 0
    magic, version, length, head, *_ = HEADER.unpack_from(raw)
    table = feature_table(raw[HEADER.size : HEADER.size + head]) if magic == MAGIC and head <= TABLE else {}
    return magic.decode("latin-1"), version, length, table, HEADER.size + head


def read_pnts_headers(payloads: DataFrame) -> DataFrame:
    """One row a payload: magic, version, stated and stored length, points, centre, colours; broken or null payloads have nulls."""

    def run(batches):
        for batch in batches:
            out = []
            for uri, raw in zip(batch["uri"], batch["payload"], strict=True):
                magic, version, length, table, _ = _parse(raw)
                out.append((uri, magic, version, length, len(raw) if raw is not None else 0, table.get("POINTS_LENGTH"), table.get("RTC_CENTER"), "RGB" in table))
            yield pd.DataFrame(out, columns=["uri", "magic", "version", "byte_length", "stored", "points", "center", "has_rgb"]).astype({"version": "Int32", "byte_length": "Int64", "points": "Int64"})

    return payloads.select("uri", "payload").mapInPandas(run, _HEADERS)


def read_pnts_points(payloads: DataFrame) -> DataFrame:
    """``uri``, ``place``, ``x``, ``y``, ``z`` (and red, green, blue, null without colours) of every point of every sound payload.

    A payload without positions, with another magic or too short for its points gives none; colours that don't fit are null.
    """

    def run(batches):
        for batch in batches:
            for uri, raw in zip(batch["uri"], batch["payload"], strict=True):
                magic, _, _, table, at = _parse(raw)
                n = table.get("POINTS_LENGTH", 0)
                start = at + table.get("POSITION", {}).get("byteOffset", 0)
                if magic != "pnts" or not n or "POSITION" not in table or start + 12 * n > len(raw):
                    continue
                xyz = np.frombuffer(raw, "<f4", 3 * n, start).reshape(n, 3).astype(np.float64) + table.get("RTC_CENTER", [0, 0, 0])
                rows = {"uri": uri, "place": np.arange(n), **{k: xyz[:, i] for i, k in enumerate("xyz")}}
                colours = at + table["RGB"]["byteOffset"] if "RGB" in table else len(raw)
                rgb = np.frombuffer(raw, np.uint8, 3 * n, colours).reshape(n, 3) if colours + 3 * n <= len(raw) else None
                rows |= {k: rgb[:, i].astype("int32") if rgb is not None else pd.array([None] * n, "Int32") for i, k in enumerate(("red", "green", "blue"))}
                yield pd.DataFrame(rows)

    return payloads.select("uri", "payload").mapInPandas(run, "uri string, place long, x double, y double, z double, red int, green int, blue int")


def validate_pnts(headers: DataFrame, expected: DataFrame) -> DataFrame:
    """``uri``, ``problem`` of every expected payload (uri, points, has_rgb) that is missing or whose header doesn't fit."""
    e = expected.select("uri", F.col("points").alias("_n"), F.col("has_rgb").alias("_c"))
    rows = e.join(headers, "uri", "left")
    fits = {"format": (F.col("magic") == "pnts") & (F.col("version") == VERSION), "length": F.col("byte_length") == F.col("stored"), "points": F.col("points") == F.col("_n"), "colours": F.col("has_rgb") == F.col("_c"), "center": F.size("center") == 3}
    problem = F.when(F.col("magic").isNull() & F.col("stored").isNull(), F.lit("missing"))
    for name, fit in fits.items():
        problem = problem.when(~F.coalesce(fit, F.lit(False)), F.lit(name))
    return rows.select("uri", problem.alias("problem")).where("problem is not null")


def tile_documents(tiles: DataFrame, key: str = "doc", diagnostics: bool = True) -> DataFrame:
    """``key``, ``json``: one nested document for each root cell of tiles (key, path, parent, error, box, uri and maybe ``extras``, a JSON text).

    ``parent`` is null at the document's root. A group is one cell's tree. ``diagnostics`` tells whether extras go in. A tile whose parent
    isn't there, or lies on a circle, isn't part of the document; a document without a root has null json.
    """
    names = [key, "path", "parent", "error", "box", "uri", *(["extras"] if "extras" in tiles.columns else [])]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        made = {}
        for r in rows.sort_values("path", key=lambda p: p.str.len(), kind="stable").itertuples():
            tile = {"boundingVolume": {"box": [float(v) for v in r.box]}, "geometricError": r.error, "refine": "ADD"}
            if isinstance(r.uri, str):
                tile["content"] = {"uri": r.uri}
            if diagnostics and isinstance(getattr(r, "extras", None), str):
                tile["extras"] = json.loads(r.extras)
            made[r.path] = tile
        roots = [p for p, q in zip(rows["path"], rows["parent"], strict=True) if not isinstance(q, str)]
        below = {}
        for path, parent in sorted({(p, q) for p, q in zip(rows["path"], rows["parent"], strict=True) if isinstance(q, str)}):
            below.setdefault(parent, []).append(path)
        if not roots:
            return pd.DataFrame({key: [rows[key].iloc[0]], "json": [None]})
        todo, seen = [roots[0]], {roots[0]}
        while todo:
            path = todo.pop()
            children = [p for p in below.get(path, []) if p not in seen]
            if children:
                made[path]["children"] = [made[p] for p in children]
                seen.update(children)
                todo += children
        root = made[roots[0]]
        return pd.DataFrame({key: [rows[key].iloc[0]], "json": [json.dumps({"asset": {"version": "1.0"}, "geometricError": root["geometricError"], "root": root}, separators=(",", ":"))]})

    return tiles.select(*names).groupBy(key).applyInPandas(one, f"{key} string, json string")


def _tiles(name: str, text: str | None) -> list[tuple]:
    """Rows of a document's tiles; one with a problem if there is no document."""
    try:
        document = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        document = None
    root = document.get("root") if isinstance(document, dict) else None
    if not isinstance(root, dict):
        return [(name, None, None, None, None, None, None, None, False, "null" if text is None else "broken" if document is None else "no root")]
    rows, todo = [], [(root, "r", None, 0)]
    while todo:
        tile, at, parent, depth = todo.pop()
        content, volume, error, children = (tile.get(k) for k in ("content", "boundingVolume", "geometricError", "children"))
        uri = content.get("uri") if isinstance(content, dict) else None
        uri = uri if isinstance(uri, str) else None
        box = volume.get("box") if isinstance(volume, dict) else None
        sound = isinstance(box, list) and len(box) == 12 and all(map(_number, box))
        external = uri is not None and uri.split("?")[0].split("#")[0].lower().endswith(".json")
        problem = "no error" if not _number(error) else "no box" if not sound else "children beside reference" if external and children else None
        refine = tile.get("refine")
        rows.append((name, at, depth, parent, float(error) if _number(error) else None, uri, refine if isinstance(refine, str) else None, [float(v) for v in box] if sound else None, external, problem))
        todo += [(child, f"{at}/{i}", at, depth + 1) for i, child in enumerate(children if isinstance(children, list) else []) if isinstance(child, dict)]
    return rows


def read_tile_documents(docs: DataFrame, key: str = "doc") -> DataFrame:
    """One row a tile of each document (key, json): ``place`` (child numbers from the root), ``depth``, ``parent``, ``error``, ``uri``, ``refine``, ``box``, whether it is ``external``, ``problem``.

    A document that is null, broken or has no root is one row without place. A tile's problem is an error or a box that isn't there
    or not of numbers, or children beside a reference to a document; what isn't sound is null.
    """
    names = [key, "place", "depth", "parent", "error", "uri", "refine", "box", "external", "problem"]

    def run(batches):
        for batch in batches:
            for name, text in zip(batch[key], batch["json"], strict=True):
                yield pd.DataFrame(_tiles(name, text if isinstance(text, str) else None), columns=names, dtype=object)

    return docs.select(key, "json").mapInPandas(run, f"{key} string, place string, depth int, parent string, error double, uri string, refine string, box array<double>, external boolean, problem string")


def metadata_maps(nodes: DataFrame, key: str = "doc") -> DataFrame:
    """``key``, ``entries``, ``json``: a map from content uri to diagnostics for each root cell of nodes (key, uri, diag). A group is one cell's tree."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("uri", "diag"))))
    return nodes.where("uri is not null").groupBy(key).agg(F.count("*").alias("entries"), F.to_json(entries).alias("json"))


def variant_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """``uri``, ``side`` of content that only one of two variants' tiles (uri) refers to, repeats counted; no rows if they match. Each variant is read once."""
    both = a.select("uri", F.lit(1).alias("_n")).unionByName(b.select("uri", F.lit(-1).alias("_n")))
    left = both.where("uri is not null").groupBy("uri").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    block = 10_000  # repeats go in blocks, so that no array grows with them
    rows = left.select("uri", F.when(F.col("_n") > 0, "first").otherwise("second").alias("side"), F.abs("_n").alias("_n"))
    rows = rows.withColumn("_b", F.explode(F.expr(f"sequence(0L, (_n - 1) div {block})")))
    return rows.withColumn("_k", F.explode(F.expr(f"sequence(1L, least({block}L, _n - _b * {block}))"))).select("uri", "side")
