"""Checks of ownership, roles, inventories and accounting."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .tree import few
from .work import written


def valid(*names: str) -> Column:
    """All of the columns are finite numbers."""
    return reduce(and_, [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) for n in names])


def z0_census(points: DataFrame) -> DataFrame:
    """``ix``, ``iy``, ``n`` (valid points) of every root cell, with ``visited`` and ``invalid`` of the whole dataset on each row.

    Points come once: they are counted by cell and validity, the totals are sums over those counts. Cells of invalid points only
    have no row; without any valid point there is none.
    """
    counts = points.groupBy(F.when(valid("x", "y", "z"), F.struct("ix", "iy")).alias("cell")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("visited"), F.coalesce(F.sum(F.when(F.col("cell").isNull(), F.col("n"))), F.lit(0)).alias("invalid"))  # one row
    return counts.where(F.col("cell").isNotNull()).select("cell.ix", "cell.iy", "n").crossJoin(F.broadcast(totals))


def _counters(expected: DataFrame, owned: DataFrame, away: Column) -> DataFrame:
    """Counters by root cell from single points: both sides meet in one aggregation by ordinal."""
    e = expected.select("ordinal", F.struct("ix", "iy").alias("e_cell"), F.col("role").alias("e_role"), F.lit(None).cast("struct<ix:int,iy:int>").alias("cell"), F.lit(None).cast("string").alias("o_role"), F.lit(False).alias("away"))
    o = owned.select("ordinal", F.lit(None).cast("struct<ix:int,iy:int>").alias("e_cell"), F.lit(None).cast("string").alias("e_role"), F.struct("ix", "iy").alias("cell"), F.col("role").alias("o_role"), away.alias("away"))
    one = e.unionByName(o).groupBy("ordinal").agg(
        F.max("e_cell").alias("e_cell"), F.max("e_role").alias("e_role"), F.count("cell").alias("m"), F.min("cell").alias("low"), F.max("cell").alias("high"), F.min("o_role").alias("low_role"), F.max("o_role").alias("high_role"), F.bool_or("away").alias("away"))
    known, held = F.col("e_cell").isNotNull(), F.col("m") > 0
    wrong = lambda want, low, high: known & held & ((F.col(low) != F.col(want)) | (F.col(high) != F.col(want)))
    cell = F.coalesce("e_cell", "low")
    return one.groupBy(cell["ix"].alias("ix"), cell["iy"].alias("iy")).agg(
        F.count_if(F.col("m") > 1).alias("duplicates"), F.count_if(known & ~held).alias("omitted"), F.count_if(~known).alias("extra"), F.count_if(wrong("e_cell", "low", "high")).alias("wrong_owner"),
        F.count_if(wrong("e_role", "low_role", "high_role")).alias("wrong_role"), F.count_if("away").alias("out_of_range"))


def suspects(expected: DataFrame, owned: DataFrame, within=("ix", "iy", "role")) -> DataFrame:
    """Ordinals (null among them, if any) that may break ownership; all others are owned once, by whoever should.

    Bitmaps of both sides are compared by cell and role: an ordinal in one only is a suspect, and so is every ordinal of a
    word that has more owned rows than ordinals.
    """
    both = bitmaps.words({"_e": expected, "_o": owned}, "ordinal", within)
    differ, again = F.col("_e") != F.col("_o"), bitmaps.repeats("_o") | bitmaps.repeats("_e")
    bits = F.when(again, F.col("_e").bitwiseOR(F.col("_o"))).otherwise(F.col("_e").bitwiseXOR(F.col("_o")))
    return bitmaps.keys_of(both.where(differ | again), bits)


def audit(expected: DataFrame, owned: DataFrame, size: float, origin: tuple[float, float]) -> DataFrame:
    """Counters by root cell: ``duplicates``, ``omitted``, ``extra``, ``wrong_owner``, ``wrong_role``, ``out_of_range`` ordinals.

    ``expected``: ordinal, ix, iy, role, each ordinal once; ``owned``: ordinal, ix, iy, role, x, y. An extra ordinal counts in
    the cell that owns it; out of range is a point outside the square of its owner. A cell without rows has no line.

    What is shuffled for all points is their bitmaps by cell and role; only the points of suspects are compared one by one. They are
    found by broadcast while few, else by a join.
    """
    inside = lambda a, o: F.col(a).between(F.col(f"i{a}") * size + o, (F.col(f"i{a}") + 1) * size + o)
    away = ~(inside("x", origin[0]) & inside("y", origin[1]))
    # nothing is expected to lie away, so whatever does is a suspect
    found = suspects(expected.withColumn("_away", F.lit(False)), owned.withColumn("_away", away), ("ix", "iy", "role", "_away"))
    marked = few(found.distinct().withColumnRenamed("ordinal", "_suspect"))
    again = lambda side: side.join(marked, F.col("ordinal").eqNullSafe(F.col("_suspect")), "left_semi")
    faults = _counters(again(expected), again(owned), away)
    names = faults.columns[2:]
    cells = expected.select("ix", "iy").distinct().select("ix", "iy", *[F.lit(0).cast("long").alias(n) for n in names])
    return cells.unionByName(faults).groupBy("ix", "iy").agg(*[F.sum(n).alias(n) for n in names])


def role_gap(expected: DataFrame, owned: DataFrame, key: str = "ordinal") -> DataFrame:
    """One row: ``missing`` (expected rows that no role owns) and ``surplus`` (owned rows beyond the expected ones), repeats counted.

    ``key`` is a whole number. Words of its bitmaps without repeats are counted as they are; rows of the others, null keys among
    them, are counted by key.
    """
    both = written(bitmaps.words({"_e": expected, "_o": owned}, key), "words")
    repeated = bitmaps.repeats("_e") | bitmaps.repeats("_o")
    bare = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b)))).cast("long")
    plain = both.where(~repeated).select(bare("_e", "_o").alias("missing"), bare("_o", "_e").alias("surplus"))
    odd = few(both.where(repeated).select(F.col("word").alias("_odd")))
    again = lambda side, d: side.join(odd, bitmaps.word(key).eqNullSafe(F.col("_odd")), "left_semi").select(key, F.lit(d).alias("d"))
    sides = again(expected, 1).unionAll(again(owned, -1)).groupBy(key).agg(F.sum("d").alias("d"))
    single = sides.select(F.greatest("d", F.lit(0).cast("long")).alias("missing"), F.greatest(-F.col("d"), F.lit(0).cast("long")).alias("surplus"))
    return plain.unionAll(single).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("missing", "surplus")])


def shared_keys(left: DataFrame, right: DataFrame, key: str = "ordinal") -> DataFrame:
    """One row, ``shared``: how many different keys (whole numbers; null is one) both sides have, from their bitmaps alone."""
    both = bitmaps.words({"_l": left, "_r": right}, key)
    shared = F.when(F.col("word").isNull(), F.least("_l_n", "_r_n", F.lit(1).cast("long"))).otherwise(F.bit_count(F.col("_l").bitwiseAND(F.col("_r"))).cast("long"))
    return both.agg(F.coalesce(F.sum(shared), F.lit(0)).alias("shared"))


def source_drift(old: DataFrame, new: DataFrame, key: str, values: list[str], position: str | None = None) -> DataFrame:
    """``key``, ``status`` for every key of either ledger: added, removed, changed, reordered (equal values at another ``position``) or same; nulls compare as equal values."""
    side = lambda df, n: df.select(key, F.struct(*values).alias(f"_{n}"), (F.col(position) if position else F.lit(0)).alias(f"_{n}p"))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    moved = ~F.col("_op").eqNullSafe(F.col("_np"))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed").when(moved, "reordered").otherwise("same")
    return both.select(key, status.alias("status"))


def extension_cells(census: DataFrame, done: DataFrame, keys=("ix", "iy")) -> DataFrame:
    """Census cells that aren't finished, with ``unknown``: how many finished cells the census doesn't have (0 for a sound ledger)."""
    unknown = done.select(*keys).distinct().join(census.select(*keys), list(keys), "left_anti").agg(F.count("*").alias("unknown"))  # one row
    return census.join(done.select(*keys).distinct(), list(keys), "left_anti").crossJoin(F.broadcast(unknown))


def merge_extension(base: DataFrame, added: DataFrame, census: DataFrame, figures=("p001", "adaptive")) -> DataFrame:
    """Figures of a finished part and of its extension in one row, with source totals from one pass: ``visited``, ``invalid``, ``outside``.

    ``base``, ``added``: one row a cell; ``census``: rows of ``z0_census``. Outside is what the census visited beyond invalid
    points and the cells of either part.
    """
    cells = base.unionByName(added)
    sums = cells.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in figures])
    held = census.join(cells.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_held"))
    totals = census.agg(F.max("visited").alias("visited"), F.max("invalid").alias("invalid"))
    one = sums.crossJoin(held).crossJoin(totals)  # three single rows
    return one.withColumn("outside", F.col("visited") - F.col("invalid") - F.col("_held")).drop("_held")
