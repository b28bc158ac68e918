"""Chunks that arrive as files, each taken once, and root cells that are finished once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodforge.operators.tree import few


def stream_chunks(rows: DataFrame, folder: str, key: str = "chunk_id") -> DataFrame:
    """``key``, ``n``, ``first`` (ordinal at which the chunk's rows of a batch begin), ``batch`` of all that ``rows``, a stream, has brought so far.

    Each batch's rows go to a folder of its number, which a replay after a crash overwrites, so no row comes twice; ordinals go
    on from the batches before. A run takes what is there and unseen, then stops. ``folder`` must be shared by the cluster.
    """
    spark = rows.sparkSession
    ledger = f"{folder}/ledger"
    schema = f"{key} string, n long, first long, batch long"
    spark.createDataFrame([], schema).drop("batch").write.mode("overwrite").parquet(f"{ledger}/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        held = spark.read.parquet(f"{folder}/rows/batch={number}")
        before = spark.read.schema(schema).parquet(ledger).where(F.col("batch") < number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        from pyspark.sql import Window

        counts = held.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("n"))  # one row a chunk
        first = F.lit(before).cast("long") + F.sum("n").over(Window.orderBy(key)) - F.col("n")
        counts.withColumn("first", first).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema).parquet(ledger)


def finalize_cells(points: DataFrame, build, folder: str, keys=("ix", "iy")) -> DataFrame:
    """Builds every root cell of ``points`` that isn't done yet and returns the ledger: ``keys``, ``rows``, ``run``.

    ``build`` takes the open cells' points to their result rows, which keep ``keys``; a cell it gives no row for is done with 0 rows. A run's
    result goes to a folder of its own; its ledger is written last, so a run that dies leaves its cells open and the next one
    replaces what it wrote. The ledger of finished cells is broadcast up to ``tree.FEW`` rows and joined by a shuffle beyond.
    """
    spark = points.sparkSession
    ledger, names = f"{folder}/ledger", list(keys)
    empty = points.select(*names).limit(0).withColumns({"rows": F.lit(0).cast("long")})
    if not _exists(spark, ledger):
        empty.write.parquet(f"{ledger}/run=0")
    schema = empty.withColumn("run", F.lit(0)).schema
    done = spark.read.schema(schema).parquet(ledger)
    run = (done.agg(F.max("run")).first()[0] or 0) + 1
    todo = points.join(few(done.select(*names)), names, "left_anti")
    build(todo).write.mode("overwrite").parquet(f"{folder}/cells/run={run}")
    made = spark.read.parquet(f"{folder}/cells/run={run}").groupBy(*names).agg(F.count("*").alias("rows"))
    made = todo.select(*names).distinct().join(made, names, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    made.write.mode("overwrite").parquet(f"{ledger}/run={run}")
    return spark.read.schema(schema).parquet(ledger)


def _exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
