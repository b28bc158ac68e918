"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket. A source's target is met by taking every document the same whole number of
times and those below a hash threshold once more. The threshold comes from nested histograms: the bucket where the budget
ends is found, only that bucket is summed again by the next bits, and so on for ``LEVELS``; then rows are filtered, not sorted.

Words are counted once and kept in a narrow table in the shared folder. The plan, one small row a source, is broadcast if its
names hold at most ``SMALL`` bytes; beyond that rows and plan meet in ``SALTS`` parts of each source, so no source is one task.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a null id hashes like an empty
one together with the text; rows repeated under one id share a fate; a source without words has target 0; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Hexadecimal digits of the hash that each level of histograms resolves.
LEVELS = (3, 3, 3)
#: Most bytes of source names (and 64 a row) of a plan that is broadcast; first digits of the hash, by which larger ones are salted.
SMALL, SALTS = 16 << 20, "0123456789abcdef"


def word_count(column: str = "text") -> Column:
    """Words of anything but ASCII white space; null: 0. Counts the places where a word ends."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_hash() -> Column:
    """Hexadecimal digits that order a document in its source."""
    return F.substring(F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("doc_id").isNull(), F.col("text")))), 1, sum(LEVELS))


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``h`` of every document."""
    return documents.select("doc_id", "source", word_count().alias("size"), row_hash().alias("h"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row a source (source, source_size).

    Targets are ``SHARE`` of all sizes by weight, each at most ``MOST`` times its source's size, the excess reshared by
    weight. With sources in the order of size over weight, the first k are at their cap for the least k whose common level
    for the rest fits below the next one's cap.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    rated = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size")).withColumn("reach", F.col("cap") / F.col("weight"))
    order = Window.orderBy("reach", "place")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("reach", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    rated = rated.withColumn("level", level)
    common = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "place", "level"))).over(every)["level"]
    return rated.withColumn("common", common).select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap")))).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``target``, ``source_size``, ``whole`` (times every document is taken), ``below`` (hash prefix that ends the rest).

    Each level is written, one row a source.

    ``rows``: source, size, h. Each level sums the bucket the budget ends in by the next digits; the last bucket counts as
    taken if that comes nearer to the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("below", F.lit(""))
    done = 0
    for level, digits in enumerate(LEVELS):
        own = rows.select(F.col("source").alias("_s"), "size", "h")
        if level:  # only rows of the bucket that the budget ends in
            own = with_plan(own, plan.select(F.col("source").alias("_p"), F.col("below").alias("_b")), "_s", "_p").where(F.substring("h", 1, done) == F.col("_b"))
        bucket = own.groupBy("_s", F.substring("h", done + 1, digits).alias("b")).agg(F.sum("size").alias("n"))
        total = F.sum("n").over(Window.partitionBy("_s").orderBy("b"))
        cut = bucket.withColumn("upto", total).join(plan, F.col("_s").eqNullSafe(F.col("source"))).where(F.col("upto") > F.col("left"))
        first = cut.groupBy("source").agg(F.min_by(F.struct("b", "n", "upto"), "b").alias("at")).withColumnRenamed("source", "_s")
        plan = plan.join(first, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        ends = F.col("at").isNotNull()
        after = F.col("left") - (F.col("at.upto") - F.col("at.n"))
        plan = plan.withColumn("left", F.when(ends, after).otherwise(F.col("left"))).withColumn("below", F.when(ends, F.concat("below", "at.b")).otherwise(F.concat("below", F.lit("g" * digits))))
        if level == len(LEVELS) - 1:
            nearer = ends & (2 * F.col("left") >= F.col("at.n"))
            plan = plan.withColumn("below", F.when(nearer, F.concat("below", F.lit("~"))).otherwise(F.col("below")))
        plan = materialize(plan.drop("at"), "plan")
        done += digits
    return plan.drop("left")


def with_plan(rows: DataFrame, plan: DataFrame, source: str, key: str) -> DataFrame:
    """``rows`` (with ``h``) joined to the one row of ``plan`` that ``key`` has for their ``source``, null being a source."""
    held = plan.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(key), F.lit(0)) + 64), F.lit(0))).first()[0]
    if held <= SMALL:
        return rows.join(F.broadcast(plan), F.col(source).eqNullSafe(F.col(key)))
    spread = plan.withColumn("__salt", F.explode(F.array(*map(F.lit, SALTS))))
    return rows.withColumn("__own", F.substring("h", 1, 1)).join(spread, F.col(source).eqNullSafe(F.col(key)) & (F.col("__own") == F.col("__salt"))).drop("__own", "__salt")


def mixing_plan(narrow: DataFrame) -> DataFrame:
    """``_s`` (source), ``source_size``, ``target``, ``whole``, ``below`` from the rows of ``measured``."""
    sizes = materialize(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    return thresholds(narrow, materialize(source_targets(sizes), "targets")).select(F.col("source").alias("_s"), "source_size", "target", "whole", "below")


def mix(narrow: DataFrame) -> DataFrame:
    """``narrow`` (rows of ``measured``) with ``source_size``, ``target`` and ``times``, how often the mix takes the row."""
    times = F.col("whole") + (F.col("h") < F.col("below")).cast("long")
    return with_plan(narrow, mixing_plan(narrow), "source", "_s").withColumn("times", times).drop("_s", "whole", "below")


def mixed_sizes(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words that the mix takes) of every document."""
    return mix(materialize(measured(documents), "measured")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` as often as the mix takes them; columns stay. Whole rows are never shuffled for it."""
    columns = documents.columns
    plan = mixing_plan(materialize(measured(documents), "measured")).select("_s", "whole", "below")
    rows = documents.select(F.col("source").alias("__source"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), row_hash().alias("h"))
    times = (F.col("whole") + (F.col("h") < F.col("below")).cast("long")).cast("int")
    taken = with_plan(rows, plan, "__source", "_s").withColumn("times", times)
    return taken.where("times > 0").select("__row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("__row.*")
