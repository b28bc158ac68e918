"""Queries that read their table as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodforge.functions import geometry as g
from lodforge.operators import telemetry as tel
from lodforge.operators.work import folder, once
from lodforge.plans import registry as r
from lodforge.plans import telemetry as batch
from lodforge.sources import points as src
from lodforge.streaming.census import incremental_counts
from lodforge.streaming.cycles import follow_cycles, take_events

c = F.col


@r.query("SELECT ix, iy, count(*) AS n FROM cells GROUP BY 1,2", r._CELLS)
def stream_census(spark, sf):
    schema = spark.read.parquet(f"{sf}/lineitem.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/lineitem*.parquet")
    x, y = c("l_extendedprice") * 8 / 100 - 2600, ((c("l_suppkey") % 100) * 37.5 + c("l_quantity") * 20 - 1500).cast("double")
    return incremental_counts(rows.select(g.cell_index(x, -4000.0).alias("ix"), g.cell_index(y, -2000.0).alias("iy")), ["ix", "iy"], folder(spark))


def viewing_events(spark, sf):
    """Camera events, frames and contents of the tables as one table of events."""
    k = c("event_id") % 4
    camera = src.camera(spark, sf).select("session", "ts", "event_id", "kind")
    frames = src.frames(spark, sf).select("session", "ts", "event_id", F.lit("frame").alias("kind"), tel.settled(batch._gauges()).alias("settled"), (c("event_id") % 8 == 0).alias("deep"))
    kind = F.when(k == 2, "ready").when(k == 3, "selected").otherwise("request")
    contents = src.timing(spark, sf).select("session", "ts", "event_id", kind.alias("kind"), "uri", tel.request_bytes().alias("bytes"))
    return camera.unionByName(frames, True).unionByName(contents, True)


def _followed(spark, sf):
    """Cycles and contents (those with a uri) of events that come in three loads, up to six days out of order, each taken by a run of its own."""

    def build():
        slices = F.floor((F.dayofmonth("ts") - 1) / 3) + F.pmod(F.hash("event_id"), F.lit(3))
        events, place = viewing_events(spark, sf).withColumn("load", F.least(F.lit(2), F.floor(slices / 4))), folder(spark)
        schema = events.drop("load").schema
        for load in range(3):
            events.where(c("load") == load).drop("load").write.mode("append").parquet(f"{place}/events")
            arriving = spark.readStream.schema(schema).parquet(f"{place}/events")
            run = follow_cycles if load == 2 else take_events
            found = run(arriving, f"{place}/state", "9 days", batch.QUIET, batch.TIMEOUT)
        cycles, contents = found
        return cycles.unionByName(contents, True)

    return once(spark, ("followed", sf), build)


def _followed_cycles(spark, sf):
    return _followed(spark, sf).where("uri is null").select("session", "cycle", "stopped", "status", "closed", "target")


def _followed_contents(spark, sf):
    return _followed(spark, sf).where("uri is not null").drop("stopped", "status", "closed", "target")


def _same(name):
    """The twin of the batch query, which a stream of the same events must equal."""

    def add(f):
        r.QUERIES[f.__name__], r.ORACLES[f.__name__] = f, r.ORACLES[name]
        return f

    return add


@_same("refinement_cycles")
def stream_refinement_cycles(spark, sf):
    return _followed_cycles(spark, sf).withColumns({k: r._r(c(k), 3) for k in ("stopped", "closed")})


@_same("content_lifecycle")
def stream_content_lifecycle(spark, sf):
    return _followed_contents(spark, sf)


@_same("ready_never_selected")
def stream_ready_never_selected(spark, sf):
    return tel.ready_never_selected(_followed_contents(spark, sf), _followed_cycles(spark, sf))
