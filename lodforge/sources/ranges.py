"""Files by their first bytes: a task reads a stated range of each of its files, never a whole file."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodforge.operators.work import written

from .filetree import place
from .payloads import HEADER, MAGIC, TABLE, feature_table

#: File systems that a task can read ranges of by itself.
SCHEMES = ("file", "hdfs", "s3", "gs")
#: Tasks that scan a listing, or eight a core if that is more.
SCANS = 256
#: Files that a task lists at once.
LISTED = 10_000


def listing(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """``path``, ``size``, ``modified`` (null for empty files) of every file; contents aren't read.

    Spark's scan leaves out empty files, so those come from its list of the files' names, which the driver holds in any case. Files are
    scanned once, by a bounded number of tasks: by itself Spark starts one for some thirty files, and each task reports to the driver.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    rows = found.select(F.col("path").alias("_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = rows.coalesce(max(SCANS, 8 * spark.sparkContext.defaultParallelism))
    names = spark.createDataFrame([(unquote(name),) for name in found.inputFiles()], "_name string")
    same = lambda path: F.regexp_replace(path, r"^([a-z0-9]+):/+", "$1:/").alias("_same")  # noqa: E731  one slash or three
    every = rows.select("*", same("_path")).unionByName(names.select("*", same("_name")), allowMissingColumns=True)
    told = every.groupBy("_same").agg(F.coalesce(F.max("_path"), F.max("_name")).alias("path"), F.coalesce(F.max("size"), F.lit(0)).alias("size"), F.max("modified").alias("modified"))
    return told.drop("_same")


def _entries(top: str) -> Iterator[tuple[str, int, float, bool]]:
    """Path, size, time and whether it is a folder, of what lies in a folder or of a file itself; what Spark's readers take for hidden is left out."""
    system, root = place(top)
    seen = lambda name: not name.startswith((".", "_")) and not name.endswith("._COPYING_")
    if isinstance(system, fs.LocalFileSystem):  # one entry at a time, other stores give a folder's entries as one list
        if os.path.isdir(root):
            with os.scandir(root) as entries:
                for e in entries:
                    if seen(e.name):
                        told = e.stat()
                        yield f"{root}/{e.name}", told.st_size, told.st_mtime, e.is_dir()
        else:
            told = os.stat(root)
            yield root, told.st_size, told.st_mtime, False
        return
    own = system.get_file_info(root)
    lead = top[: len(top) - len(root)] if top.endswith(root) else top.split("://")[0] + "://"
    for e in system.get_file_info(fs.FileSelector(root)) if own.type == fs.FileType.Directory else [own]:
        if e is own or seen(e.base_name):
            yield lead + e.path, e.size or 0, e.mtime.timestamp() if e.mtime else 0.0, e.type == fs.FileType.Directory


def walked(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """``path``, ``size``, ``modified`` of every file in folders, as ``listing`` gives them, but listed by tasks, a folder each.

    The driver holds no file's name. Folders below go round by round through a written table, dealt to four tasks a core.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list) -> pd.DataFrame:
            told = pd.DataFrame(rows, columns=["path", "size", "modified", "folder"])
            return told.assign(modified=pd.to_datetime(told["modified"], unit="s", utc=True).dt.floor("us"))

        rows = []
        for batch in batches:
            for top in batch["path"]:
                for entry in _entries(top):
                    rows.append(entry)
                    if len(rows) >= LISTED:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)

    tasks = 4 * spark.sparkContext.defaultParallelism
    now, found = spark.createDataFrame([(p,) for p in paths], "path string"), []
    while True:
        told = written(now.repartition(tasks, "path").mapInPandas(look, "path string, size long, modified timestamp, folder boolean"), "walked")
        found.append(told.where("not folder").drop("folder"))
        now = told.where("folder").select("path")
        if not recursive or now.isEmpty():
            return reduce(DataFrame.unionByName, found)


def reachable(spark: SparkSession, paths: str | list[str]) -> list[str] | None:
    """``paths`` in full if tasks can list and read them by themselves; None if one is a pattern or lies in a store that only Spark's readers reach."""
    told = []
    for path in [paths] if isinstance(paths, str) else paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        full = system.makeQualified(where).toString()
        if re.search(r"[*?{}\[\]\\]", path) or full.split(":")[0] not in SCHEMES:
            return None
        if not system.exists(where):
            raise FileNotFoundError(path)
        told.append(re.sub("^file:/+", "/", full))
    return told


def every_file(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """Files by ``walked`` where tasks can, else by ``listing``."""
    told = reachable(spark, paths)
    return listing(spark, paths, recursive) if told is None else walked(spark, told, recursive)


def read_ranges(files: DataFrame, take: Callable, schema: str) -> DataFrame:
    """``files`` (path and other columns) with the columns of ``schema`` that ``take(read, size)`` gives, and ``bytes_read``.

    ``read(offset, length)`` gives a file's bytes there, fewer at its end. Files are dealt by path, as a listing may lie in few tasks.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = []
            for path, size in zip(batch["path"], batch["size"], strict=True):
                system, name = place(path)
                count = 0
                with system.open_input_file(name) as file:

                    def read(offset: int, length: int) -> bytes:
                        nonlocal count
                        file.seek(offset)  # noqa: B023
                        raw = file.read(length)  # noqa: B023
                        count += len(raw)
                        return raw

                    told.append((*take(read, size), count))
            found = pd.DataFrame(told, columns=[*names, "bytes_read"], dtype=object)
            yield pd.concat([batch.reset_index(drop=True), found], axis=1)

    columns = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "path").mapInPandas(run, f"{columns}, {schema}, bytes_read long")


def readable(files: DataFrame) -> bool:
    """Whether tasks can read ranges of the files by themselves; else only Spark's readers reach them."""
    first = next(iter(files.inputFiles()), "")  # known without a scan
    return ":" not in first or first.split(":")[0] in SCHEMES


def _header(read: Callable, size: int) -> tuple:
    raw = read(0, HEADER.size)
    if len(raw) < HEADER.size:
        return None, None, None, None, None, False
    magic, version, length, head, *_ = HEADER.unpack(raw)
    table = feature_table(read(HEADER.size, min(head, max(0, size - HEADER.size)))) if magic == MAGIC and head <= TABLE else {}
    return magic.decode("latin-1"), version, length, table.get("POINTS_LENGTH"), table.get("RTC_CENTER"), "RGB" in table


def file_headers(files: DataFrame) -> DataFrame:
    """``files`` with a payload's ``magic``, ``version``, ``byte_length``, ``points``, ``center``, ``has_rgb``; nulls for what isn't sound."""
    return read_ranges(files, _header, "magic string, version int, byte_length long, points long, center array<double>, has_rgb boolean")
