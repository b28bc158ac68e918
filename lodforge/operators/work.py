"""Tables written to the cluster's shared folder, which end a lineage and outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which every executor must see; an error where that is unset.

    A single-process session (master ``local``) without the setting gets its warehouse folder, which is the same disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/lodforge-core-{spark.sparkContext.applicationId}"


def folder(spark: SparkSession) -> str:
    """A new folder under ``base``."""
    return f"{base(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = f"{folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what lies under a path; nothing there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` wrote and nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            remove(df.sparkSession, file.rsplit("/", 1)[0])


#: Tables that a session has written once, by application and key.
_ONCE: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files under a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True), []
    while files.hasNext():
        file = files.next()
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return tuple(sorted(found))


def _full(spark: SparkSession, key: tuple) -> tuple:
    return (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), *key, *(_state(spark, k) for k in key[1:] if isinstance(k, str) and "/" in k))


#: Tables that are worked out at each read from small tables written once.
_PLANS: dict[tuple, DataFrame] = {}


def remembered(spark: SparkSession, key: tuple, build) -> DataFrame:
    """The unwritten table of ``key``, as for ``once``: what ``build`` writes on its way is written once."""
    full = _full(spark, key)
    if full not in _PLANS:
        _PLANS[full] = build()
    return _PLANS[full]


def once(spark: SparkSession, key: tuple, build) -> DataFrame:
    """The table of ``key`` (a name and the folder it is made of), written by the first call of this application.

    It is written again if its files are gone or those of the folder have changed.
    """
    full = _full(spark, key)
    held = _ONCE.get(full)
    if held is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(held[1])
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return spark.read.schema(held[0]).parquet(held[1])
    df = build()
    path = f"{folder(spark)}/{key[0]}"
    df.write.parquet(path)
    _ONCE[full] = (df.schema, path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes every working table of this application; results that still read them end with it."""
    for key in [k for k in _ONCE if k[0] == spark.sparkContext.applicationId]:
        del _ONCE[key]
    for key in [k for k in _PLANS if k[0] == spark.sparkContext.applicationId]:
        del _PLANS[key]
    remove(spark, base(spark))
