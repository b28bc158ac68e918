"""Sharding by fixed virtual slots, with DataFrame operations only.

Records hash into ``SLOTS`` virtual slots; bytes are summed per slot; a slot-to-shard map, one version a folder, deals the
slots to shards of near-equal bytes (largest slot first, each to the lightest shard). Rebalancing writes the map's next
version and moves slots only. All that is gathered is one row a slot, a fixed bound. Texts are read once; their narrow columns,
equal ones counted first, are shuffled once and written.

Defined cases: a null text has no bytes and the checksum of nothing; a null id hashes by its text's size and checksum; rows equal
in id, size and checksum go to slots by blocks of ``COPIES``, so however many there are they fill no slot, and each gets a place
of its own; ties go by id, size, checksum and block; an empty table gives no rows and an even map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, work_dir

SLOTS, SHARDS, OVERHEAD, COPIES = 8192, 24, 8, 16


def virtual_slot(slots: int = SLOTS) -> Column:
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws("/", F.lit("none"), "size", "text_crc32"))
    return F.pmod(F.when(F.col("block") == 0, F.xxhash64(own)).otherwise(F.xxhash64(own, "block")), F.lit(slots)).cast("int")


def record_bytes() -> Column:
    return (F.octet_length(text_or_empty()) + OVERHEAD).cast("long")


def records(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``block``, ``copies``, ``vslot``: one row for up to ``COPIES`` equal records, written."""
    narrow = documents.select("doc_id", record_bytes().alias("size"), F.crc32(F.encode(text_or_empty(), "utf-8")).alias("text_crc32"))
    counted = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    copies = F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("block") * COPIES)
    return materialize(blocks.select("doc_id", "size", "text_crc32", "block", copies.alias("copies"), virtual_slot(slots).alias("vslot")), "records")


def slot_bytes(held: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``vslot``, ``bytes``, ``rows`` for every slot of ``records``, empty slots too."""
    held = held.groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))
    every = held.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(held, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def deal(weights: DataFrame, shards: int, start: list[int] | None = None) -> DataFrame:
    """Each row of ``weights`` (vslot, bytes) to the shard lightest so far, heaviest rows first: ``vslot``, ``shard``.

    Folds one array of at most ``SLOTS`` rows.
    """
    ordered = weights.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("w"), F.col("vslot").alias("v")))).alias("rows"))
    begin = F.array(*[F.lit(x).cast("long") for x in (start or [0] * shards)])

    def step(state, row):
        lightest = (F.array_position(state["load"], F.array_min(state["load"])) - 1).cast("int")
        load = F.transform(state["load"], lambda x, i: F.when(i == lightest, x - row["w"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(state["out"], F.array(lightest)).alias("out"))

    folded = ordered.select("rows", F.aggregate("rows", F.struct(begin.alias("load"), F.array().cast("array<int>").alias("out")), step)["out"].alias("out"))
    return folded.select(F.explode(F.arrays_zip(F.col("rows.v").alias("vslot"), F.col("out").alias("shard"))).alias("r")).select("r.vslot", "r.shard")


class SlotMap:
    """Versions of a slot-to-shard map under one folder; a version is written once and never changed."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{work_dir(spark)}/slot-map"

    def write(self, rows: DataFrame, version: int) -> DataFrame:
        rows.select("vslot", "shard").coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("vslot int, shard int").parquet(f"{self.path}/version={version}")

    def create(self, weights: DataFrame, shards: int = SHARDS) -> DataFrame:
        return self.write(deal(weights, shards), 1)

    def rebalance(self, version: int, weights: DataFrame, shards: int) -> DataFrame:
        """The next version: a slot stays unless its shard is gone or the slots before it, heaviest first, already fill the mean.

        Only the slots that leave are dealt again. With more shards than before, overfull shards feed the new ones.
        """
        known = self.read(version).join(weights.select("vslot", "bytes"), "vslot")
        total = known.agg(F.sum("bytes")).first()[0] or 0
        filled = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot"))
        marked = known.withColumn("stays", (F.col("shard") < shards) & (filled * shards <= total * F.lit(1.0) + F.col("bytes") * shards / 2))
        kept = marked.where("stays")
        loads = {r["shard"]: r["b"] for r in kept.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}  # one row a shard
        moved = deal(marked.where(~F.col("stays")), shards, [int(loads.get(s, 0)) for s in range(shards)])
        return self.write(kept.select("vslot", "shard").unionByName(moved), version + 1)


def shard_documents(held: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` (place in the shard, gapless from 0), ``vslot`` of every record.

    A place is the rows of the shard's earlier virtual slots plus the rank in the own one, so no shard meets in one task.
    """
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("rows")
    starts = slot_bytes(held, slots).select("vslot", "rows").join(slot_map, "vslot").select("vslot", "shard", before.alias("before"))
    earlier = F.sum("copies").over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32", "block")) - F.col("copies")
    placed = held.withColumn("earlier", earlier).join(F.broadcast(starts), "vslot")  # one row a slot
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return copies.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("earlier") + F.col("copy")).cast("long").alias("slot"), "vslot")
