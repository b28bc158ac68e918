"""Identifier, reference and display-text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_tile_id(s: Column) -> tuple[Column, Column, Column]:
    """Level, x, y of a tile id or of a file named by it; null if malformed."""
    pattern = r"(?:^|/)z(\d+)_x(-?\d+)_y(-?\d+)(?:\.\w+)?$"
    return tuple(F.when(s.rlike(pattern), F.regexp_extract(s, pattern, k)).cast("int") for k in (1, 2, 3))


def parse_node_uri(uri: Column) -> tuple[Column, Column, Column, Column]:
    """Root cell, depth, path and whether the payload is the overview's."""
    node = r"(z0_x-?\d+_y-?\d+)/d(\d+)_q(\d*)\.pnts$"
    return tuple(F.when(uri.rlike(node), F.regexp_extract(uri, node, k)) for k in (1, 2, 3)) + (uri.rlike(r"points/z0/z0_x-?\d+_y-?\d+\.pnts$"),)


def request_kind(uri: Column) -> Column:
    return F.when(uri.endswith(".pnts"), "content").when(uri.endswith(".json"), "tileset").otherwise("other")


def human_bytes(n: Column) -> Column:
    step = lambda k, unit: F.concat(F.format_string("%.1f", F.round(n / 1024.0**k, 1)), F.lit(f" {unit}"))
    ladder = [(n < 1024.0 ** (k + 1), step(k, u)) for k, u in ((1, "KiB"), (2, "MiB"), (3, "GiB"))]
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(reduce(lambda other, c: F.when(c[0], c[1]).otherwise(other), reversed(ladder), step(4, "TiB")))


def human_duration(s: Column) -> Column:
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    minutes, rest = F.floor(s / 60) % 60, F.floor(s) % 60
    return F.when(s >= 3600, F.concat_ws(":", two(F.floor(s / 3600)), two(minutes), two(rest))).otherwise(F.concat_ws(":", two(F.floor(s / 60)), two(rest)))


def is_contained(owner: Column, uri: Column) -> Column:
    """A reference stays relative and under the root after ``..`` is folded; ``owner`` is the owning directory."""
    parts = F.split(F.concat_ws("/", owner, uri), "/")
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda s, p: F.struct(F.when(p == "..", s["d"] - 1).when((p == ".") | (p == ""), s["d"]).otherwise(s["d"] + 1).alias("d"), (s["ok"] & ~((p == "..") & (s["d"] == 0))).alias("ok")))
    return ~uri.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|/)") & depth["ok"]


def canonical_uri(uri: Column) -> Column:
    """Backslashes turned, query and fragment gone; an absolute reference gives its path with its slash, others lose a leading
    slash and ``./``; one that climbs out stays marked as relative. Null stays null."""
    plain = F.regexp_replace(F.translate(uri, "\\", "/"), r"[?#].*$", "")
    absolute = plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    path = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.when(absolute, path).when(plain.rlike(r"^\.\./"), F.concat(F.lit("relative:"), plain)).otherwise(F.regexp_replace(plain, r"^(\./|/)+", ""))


def human_count(n: Column) -> Column:
    step = lambda k, unit: F.concat(F.format_string("%.1f", F.round(n / 1000.0**k, 1)), F.lit(unit))
    return F.when(n >= 1e9, step(3, "B")).when(n >= 1e6, step(2, "M")).when(n >= 1e3, step(1, "K")).otherwise(n.cast("string"))


def human_meters(m: Column) -> Column:
    """Whole metres below a kilometre; kilometres with two decimals, from ten on with one; a minus sign leads."""
    size = F.abs(m)
    kilo = lambda digits: F.concat(F.format_string(f"%.{digits}f", F.round(size / 1000.0, digits)), F.lit(" km"))
    label = F.when(size >= 10000, kilo(1)).when(size >= 1000, kilo(2)).otherwise(F.concat(F.round(size).cast("long").cast("string"), F.lit(" m")))
    return F.concat(F.when(m < 0, "-").otherwise(""), label)


def rebase_uri(uri: Column, old: Column, new: Column) -> Column:
    """A relative reference of a document in directory ``old`` as one of a document in directory ``new``; absolute references stay.

    Directories are paths from one root, "" being it. ``.`` and ``..`` are folded; a reference that climbs over the root stays null.
    """
    split = lambda p: F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    none = F.array().cast("array<string>")
    step = lambda a, s: F.when(s != "..", F.concat(a, F.array(s))).when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
    fold = lambda parts: F.aggregate(parts, none, step)
    target, base = fold(F.concat(split(old), split(uri))), fold(split(new))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(target), F.size(base)), F.lit(1))), lambda k: (k <= F.size(target)) & (k <= F.size(base)) & (F.slice(target, F.lit(1), k) == F.slice(base, F.lit(1), k))))
    moved = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(base) - shared), F.slice(target, shared + 1, F.greatest(F.size(target) - shared, F.lit(0)))), "/")
    return F.when(uri.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|/)"), uri).otherwise(moved)
