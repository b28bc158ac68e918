"""What files tell: fingerprints, sizes, reports, hashes of profiles."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodforge.operators.work import written

from . import ranges

MIB = 1 << 20


def _dataset(ledger: DataFrame) -> DataFrame:
    """``dataset``: SHA-256 of the files as a JSON list in name order. As a hash takes its text in order, one task streams it; what it sorts is spilled."""

    def run(batches):
        told, between = hashlib.sha256(b"["), b""
        for batch in batches:
            for text in batch["text"]:
                told.update(between + text.encode())
                between = b","
        told.update(b"]")
        yield pd.DataFrame({"dataset": [told.hexdigest()]})

    keys = ["name", "size", "sha256"]
    ordered = ledger.select(*keys).repartition(1).sortWithinPartitions(*keys)
    return ordered.select(F.to_json(F.struct(*keys)).alias("text")).mapInPandas(run, "dataset string")


def fingerprints(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """``name``, ``size``, ``modified``, ``sha256`` (of the first MiB), ``bytes_read`` of every file, with ``dataset`` (hash over the files in name order) and ``salt`` (its first 16 digits).

    A task reads a file's first MiB only, so files may have any size. In a store that only Spark's readers reach, files are read whole.
    Folders are listed by tasks, and the hash over all files is streamed, so neither the driver nor a task holds all names.
    """
    found = ranges.every_file(spark, paths, recursive)
    if ranges.reachable(spark, paths) is not None or ranges.readable(found):
        hashed = ranges.read_ranges(found, lambda read, size: (hashlib.sha256(read(0, MIB)).hexdigest(),), "sha256 string")
    else:
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
        hashed = whole.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2(F.substring("content", 1, MIB), 256).alias("sha256"), F.col("length").alias("bytes_read"))
    ledger = written(hashed.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size", "modified", "sha256", "bytes_read"), "fingerprints")
    return ledger.crossJoin(F.broadcast(_dataset(ledger))).withColumn("salt", F.substring("dataset", 1, 16))


def crs_name(metadata: Column) -> Column:
    """Name of a coordinate system: ``name`` of a JSON text, else the quoted name that follows a WKT text's first bracket; null for others."""
    wkt = F.regexp_extract(metadata, r'^[A-Z_]+\[\s*"([^"]*)"', 1)
    return F.coalesce(F.get_json_object(metadata, "$.name"), F.nullif(wkt, F.lit("")))


def source_metrics(spark: SparkSession, paths: str | list[str], dimensions: list[str], metadata: str | None = None) -> DataFrame:
    """One row: ``files``, ``bytes``, ``has_rgb`` (dimension names hold red, green and blue in any case), ``crs``. File contents aren't read."""
    names = {d.lower() for d in dimensions}
    files = spark.read.format("binaryFile").load(paths).select("length")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumns({"has_rgb": F.lit({"red", "green", "blue"} <= names), "crs": crs_name(F.lit(metadata).cast("string"))})


def read_reports(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """JSON reports of any number of files as one table with ``chunk_id``, the folder that holds each; a file without fields gives nulls."""
    rows = spark.read.schema(schema).json(pattern, multiLine=True)
    return rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("chunk_id"), *[F.col(c) for c in rows.columns if c != "chunk_id"])


def profile_hash(profile: Column) -> Column:
    """SHA-256 of a map as JSON with its keys in order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(profile)))), 256)
