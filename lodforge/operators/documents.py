"""Tile documents that refer to further documents: resolved against the referring one, a join a round, whatever the texts hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodforge.functions import text as t
from lodforge.sources.payloads import read_tile_documents

from .walks import strong_components
from .work import discard, written


def _folder(uri):
    return F.regexp_replace(uri, r"(^|/)[^/]*$", "")


def resolve_documents(docs: DataFrame, entry: str) -> DataFrame:
    """Every tile of ``docs`` (uri, json; uris are paths from one root) that ``entry`` leads to, and every problem on the way.

    Columns: ``doc``, ``steps`` (fewest references from the entry), ``place``, ``depth``, ``parent``, ``error``, ``uri``, ``target`` (``uri`` as a path
    from the root, without query and fragment), ``external``, ``problem``. A reference's problem: ``remote`` (absolute or another host's),
    ``escapes`` the root, ``missing`` document, ``circle`` of documents, ``error grows`` (the document referred to has a larger one at its
    root), else that of its tile. A document that can't be read is one row with its problem and no place; an entry that isn't
    there is one such row, ``missing``.
    """
    spark = docs.sparkSession
    held = written(docs.select("uri", "json").dropDuplicates(["uri"]), "documents")
    known = held.select(F.col("uri").alias("target")).withColumn("_known", F.lit(True))
    rounds = [written(spark.createDataFrame([(entry,)], "doc string").withColumn("steps", F.lit(0)), "reached")]
    reached, tiles = rounds[0], []
    while not rounds[-1].isEmpty():
        texts = rounds[-1].join(held.withColumnRenamed("uri", "doc"), "doc")
        plain = F.regexp_replace("uri", r"[?#].*$", "")
        remote = F.col("uri").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|/)")
        read = read_tile_documents(texts).drop("refine", "box").withColumn("steps", F.lit(len(rounds) - 1))
        read = read.withColumn("target", F.when(~remote, t.rebase_uri(plain, _folder(F.col("doc")), F.lit(""))))
        read = read.join(known, "target", "left")
        told = F.when(remote, "remote").when(F.col("uri").isNotNull() & F.col("target").isNull(), "escapes").when(F.col("external") & F.col("_known").isNull(), "missing")
        tiles.append(written(read.withColumn("problem", F.coalesce(told, "problem")).drop("_known"), "tiles"))
        further = tiles[-1].where("external and target is not null").select(F.col("target").alias("doc")).distinct().join(held.select(F.col("uri").alias("doc")), "doc", "left_semi")
        rounds.append(written(further.join(reached, "doc", "left_anti").withColumn("steps", F.lit(len(rounds))), "reached"))
        reached = reached.unionByName(rounds[-1])
    every = tiles[0]
    for more in tiles[1:]:
        every = every.unionByName(more)
    links = written(every.where("external and problem is null").select(F.col("doc").alias("src"), F.col("target").alias("dst")).distinct(), "links")
    part = strong_components(links)
    ends = [part.select(F.col("doc").alias(name), F.col("component").alias(f"_{name}")) for name in ("doc", "target")]
    roots = every.where("place = 'r'").select(F.col("doc").alias("target"), F.col("error").alias("_error"))
    every = every.join(ends[0], "doc", "left").join(ends[1], "target", "left").join(roots, "target", "left")
    circle = F.col("external") & (F.col("_doc") == F.col("_target"))
    grows = F.col("external") & (F.col("_error") > F.col("error") + 1e-6)
    problem = F.coalesce("problem", F.when(circle, "circle").when(grows, "error grows"))
    columns = ["doc", "steps", "place", "depth", "parent", "error", "uri", "target", "external"]
    found = every.select(*columns, problem.alias("problem"))
    absent = rounds[0].join(held.withColumnRenamed("uri", "doc"), "doc", "left_anti").select("doc", "steps", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in columns[2:-1]], F.lit(False).alias("external"), F.lit("missing").alias("problem"))
    discard(*rounds[1:])
    return found.unionByName(absent)


def unreferenced(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """``uri`` of documents that the entry never leads to."""
    return docs.select("uri").distinct().join(resolved.select(F.col("doc").alias("uri")).distinct(), "uri", "left_anti")
