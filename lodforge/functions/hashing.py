"""A salted 64-bit mix of ordinals as Column arithmetic on two 32-bit halves, so that ANSI mode meets no overflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: The increment and the (shift, multiplier) rounds of splitmix64, its last shift, and the default salt.
INCREMENT, ROUNDS, LAST, SALT = 0x9E3779B97F4A7C15, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)), 31, 0x9ABCDEF012345678


def _halves(value: int):
    return F.lit(value >> 32), F.lit(value & MASK)


def _step(df: DataFrame, high, low) -> DataFrame:
    """Both halves become columns at once; expressions don't grow from round to round."""
    return df.withColumns({"hi": high.cast("long"), "lo": low.cast("long")})


def _folded(df: DataFrame, shift: int) -> DataFrame:
    h, l = F.col("hi"), F.col("lo")
    right = F.shiftright(l, shift).bitwiseOR(F.shiftleft(h, 32 - shift).bitwiseAND(F.lit(MASK)))
    return _step(df, h.bitwiseXOR(F.shiftright(h, shift)), l.bitwiseXOR(right))


def _product(x, factor: int):
    """x * factor for 32-bit values; below 2^53 as the upper half-word's product is cut to 16 bits first."""
    return x * F.lit(factor & 0xFFFF) + F.shiftleft((x * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)


def _times(df: DataFrame, factor: int) -> DataFrame:
    upper, lower = factor >> 32, factor & MASK
    h, l = F.col("hi"), F.col("lo")
    low = _product(l, lower)
    carry = F.shiftright(low, 32) + F.shiftright(l * F.lit(lower >> 16), 16)
    high = carry + _product(h, lower).bitwiseAND(F.lit(MASK)) + _product(l, upper).bitwiseAND(F.lit(MASK))
    return _step(df, high.bitwiseAND(F.lit(MASK)), low.bitwiseAND(F.lit(MASK)))


def with_stable_hash(points: DataFrame, salt: int = SALT) -> DataFrame:
    """``points`` with ``hi`` and ``lo``, the halves of the hash of ``ordinal``; (hi, lo) sorts as the unsigned hash does."""
    sh, sl = _halves(salt)
    own = F.col("ordinal").cast("long")
    df = _step(points, F.shiftrightunsigned(own, 32).bitwiseXOR(sh), own.bitwiseAND(F.lit(MASK)).bitwiseXOR(sl))
    ih, il = _halves(INCREMENT)
    low = F.col("lo") + il
    df = _step(df, (F.col("hi") + ih + F.shiftright(low, 32)).bitwiseAND(F.lit(MASK)), low.bitwiseAND(F.lit(MASK)))
    for shift, factor in ROUNDS:
        df = _times(_folded(df, shift), factor)
    return _folded(df, LAST)
