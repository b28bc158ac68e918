"""Tables that a stream keeps up to date: a batch's rows go to a folder of its number, so a batch replayed after a crash replaces itself."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """Keeps the state of queries started inside in RocksDB, which holds more keys than memory and which arbitrary state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def advance(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Takes what the stream has and hasn't been seen by a run with this ``folder``, then stops; all rows told so far, with ``batch``.

    ``folder`` must be shared by the cluster. It holds the query's progress and state, so a run goes on where the last one ended
    or died.
    """
    spark = stream.sparkSession
    updates = f"{folder}/updates"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{updates}/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    with rocks_state(spark):
        stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(updates)


def latest(updates: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of each key's rows the one with the greatest ``batch``, then ``order``."""
    rest = [c for c in updates.columns if c not in keys]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", *order)).alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in rest if c not in ("batch", *order)])
