"""Sets of whole numbers as bitmaps in words of 64, aggregated before they are shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a key that tell its place in a word.
_PLACE = 6


def word(key: str) -> Column:
    """Number of the word that holds a key; null for a null key."""
    return F.shiftright(F.col(key).cast("long"), _PLACE)


def words(sides: dict[str, DataFrame], key: str = "ordinal", within: tuple[str, ...] = ()) -> DataFrame:
    """``word``, the ``within`` columns, and for each side its bits (named as the side) and its rows (``<side>_n``).

    One row for every 64 neighbouring keys that a side has, so keys laid out in order leave a task as a 64th of their rows.
    Null keys share a null word without bits.
    """
    place = F.expr(f"shiftleft(1L, cast(cast(`{key}` AS bigint) & {(1 << _PLACE) - 1} AS int))")
    rows = [
        df.select(word(key).alias("word"), *within, *[c for s in sides for c in ((place if s == name else F.lit(None).cast("long")).alias(s), F.lit(int(s == name)).cast("long").alias(f"{s}_n"))])
        for name, df in sides.items()
    ]
    sums = [c for s in sides for c in (F.coalesce(F.bit_or(s), F.lit(0).cast("long")).alias(s), F.sum(f"{s}_n").alias(f"{s}_n"))]
    return reduce(DataFrame.unionAll, rows).groupBy("word", *within).agg(*sums)


def repeats(side: str) -> Column:
    """A word holds more rows of the side than keys; also any null key."""
    return F.col(f"{side}_n") > F.bit_count(side)


def keys_of(table: DataFrame, bits: Column, key: str = "ordinal") -> DataFrame:
    """The keys of the set bits, one a row; those of null words are null."""
    places = F.expr(f"filter(sequence(0, {(1 << _PLACE) - 1}), k -> bit_get(_bits, k) = 1)")
    of = table.select("word", bits.alias("_bits"))
    return of.select("word", F.explode_outer(F.when(F.col("word").isNotNull(), places)).alias("_k")).select((F.shiftleft("word", _PLACE) + F.col("_k")).alias(key))
