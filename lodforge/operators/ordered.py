"""Running values over ordered rows whose keys may hold any share of them.

Rows are dealt once by ranges of key and order, so a key's rows lie in one slice or in neighbouring ones, and a slice is one task's work. A
running value is the slice's own window combined with what the slices before hand on: sums, extremes and last values combine
associatively, so a slice hands on one row a key. As slices follow the order, only the first key of a slice can have begun in
another one: at most one row a slice passes through the driver and is broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import written

SLICE = "_slice"


def sliced(rows: DataFrame, keys: list[str], order: list[str], name: str = "sliced") -> DataFrame:
    """``rows``, written once, with the number of their slice."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return written(dealt.withColumn(SLICE, F.spark_partition_id()), name)


def running(rows: DataFrame, keys: list[str], order: list[str], before: bool = False, **folds: tuple[str, Column]) -> DataFrame:
    """``rows`` of ``sliced`` with a column for each fold: ``sum`` (0 if none), ``min``, ``max`` or ``last`` (not null) up to the row, or ``before`` it.

    ``keys`` must be constant over a stretch of the order, as the slicing keys are, or those with a running count. Null keys are a key.
    """
    each = rows.withColumns({f"__v_{n}": v for n, (_, v) in folds.items()})
    value = lambda n: F.col(f"__v_{n}")
    window = Window.partitionBy(SLICE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    plain = {"sum": F.sum, "min": F.min, "max": F.max}
    last = lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))
    ordered = lambda v: F.last(v, ignorenulls=True)
    whole = each.groupBy(SLICE, *keys).agg(*[(plain[kind](value(n)) if kind in plain else last(value(n))).alias(f"__t_{n}") for n, (kind, _) in folds.items()])
    past = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.withColumn("__p", F.count("*").over(past)).withColumns({f"__c_{n}": (plain[kind] if kind in plain else ordered)(F.col(f"__t_{n}")).over(past) for n, (kind, _) in folds.items()}).where("__p > 0")
    carried = carried.select(F.col(SLICE).alias("__s"), *[F.col(k).alias(f"__k_{k}") for k in keys], *[f"__c_{n}" for n in folds])
    local = each.withColumns({f"__w_{n}": (plain[kind] if kind in plain else ordered)(value(n)).over(window) for n, (kind, _) in folds.items()})
    match = reduce(and_, [F.col(SLICE) == F.col("__s"), *[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]])
    alone = len(rows.inputFiles()) == 1  # a slice is a file, and nothing comes before the first
    held = [] if alone else carried.collect()  # at most one row a slice
    told = rows.sparkSession.createDataFrame(held, carried.schema)
    joined = local.join(F.broadcast(told), match, "left") if held else local.withColumns({n: F.lit(None).cast(t.dataType) for n, t in zip(told.columns, told.schema, strict=True)})
    zero = F.lit(0)
    combine = {
        "sum": lambda c, w: F.coalesce(c, zero) + F.coalesce(w, zero), "min": lambda c, w: F.least(c, w), "max": lambda c, w: F.greatest(c, w), "last": lambda c, w: F.coalesce(w, c),
    }
    return joined.select(*rows.columns, *[combine[kind](F.col(f"__c_{n}"), F.col(f"__w_{n}")).alias(n) for n, (kind, _) in folds.items()])
