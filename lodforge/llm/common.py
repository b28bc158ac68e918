"""What the operators of this subpackage share: the shared work folder, written tables, table loading."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from functools import cache, reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words everywhere here.
SPACE = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``, which every executor must see; an error where that is unset.

    A single-process session (master ``local``) without the setting gets its warehouse folder, which is the same disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lodforge-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared work folder and reads it back: the lineage ends there and outlives executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Most rows and bytes of an Arrow batch given to a Python worker; long texts make batches of fewer rows.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


@contextmanager
def bounded_batches(spark: SparkSession):
    """Holds Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES`` for the jobs run inside, then gives the session its settings back.

    A batch is held by the JVM, in the pipe and by the worker at once, and whole texts are large. Smaller limits stay.
    """
    before = {}
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)[a-z]*", spark.conf.get(name).lower()).groups()
        now = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0)
        if not 0 < now <= most:
            before[name] = spark.conf.get(name)
            spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@cache
def _trim():
    """The C library's call that returns freed pages, where it has one."""
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that this Python worker has freed back to the system.

    Workers are kept for the tasks of later stages, and allocators keep what a large text once took.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: A key with more than one in so many of the rows is frequent; there are fewer than so many of those.
FREQUENT = 1000


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` with the other columns of ``facts`` (one row a key; ``count``: its number of rows), whatever keys are frequent. Null keys are equal.

    Facts of frequent keys are broadcast, at most ``FREQUENT`` of them, so their rows stay where they are; only the rest are shuffled.
    """
    facts = materialize(facts, "facts")
    total = facts.agg(F.sum(count)).first()[0] or 0
    named = facts.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in facts.columns if c not in (*keys, count)], F.col(count).alias("__n"))
    frequent = F.col("__n") * FREQUENT > total
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    helpers = [*[f"__{k}" for k in keys], "__n"]
    hot = F.broadcast(named.where(frequent))
    near = rows.join(hot, match).drop(*helpers)
    far = rows.join(F.broadcast(named.where(frequent).select(*helpers)), match, "left_anti").join(named.where(~frequent), match).drop(*helpers)
    return near.unionByName(far)
