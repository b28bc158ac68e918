"""Streams against the batch form of the same rules."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodforge.operators import telemetry as tel
from lodforge.operators.work import folder
from lodforge.streaming.cycles import follow_cycles

SCHEMA = "session long, ts timestamp, event_id long, kind string, settled boolean, deep boolean, uri string, bytes long, part int"
BEGAN = dt.datetime(2024, 5, 1)


def at(seconds):
    return BEGAN + dt.timedelta(seconds=seconds)


def batch(events):
    """Cycles and contents of all events by the batch operators."""
    camera = events.where("kind in ('moveEnd', 'moveStart', 'settingChange')").select("session", "ts", "event_id", "kind")
    frames = events.where("kind = 'frame'").select("session", "ts", "event_id", "settled", "deep")
    contents = events.where("kind in ('request', 'ready', 'selected') and uri is not null").select("session", "ts", "event_id", "kind", "uri", "bytes")
    return tel.cycles(camera, frames), tel.lifecycle(tel.in_cycles(contents, camera))


def rows_of(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def same(found, events):
    for one, other in zip(found, batch(events), strict=True):
        assert rows_of(one) == rows_of(other.select(one.columns))


def feed(spark, events, loads, place, delay, files=1):
    """Runs the stream once for each load (a set of parts) and gives the tables after the last."""
    for load in loads:
        for part in load:
            events.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{place}/events")
        arriving = spark.readStream.schema(events.drop("part").schema).option("maxFilesPerTrigger", files).parquet(f"{place}/events")
        found = follow_cycles(arriving, f"{place}/state", delay)
    return found


def made(sessions=5, n=120):
    """Random events; two thirds keep time order by parts of a minute, the others come up to two parts late."""
    dice, out = random.Random(7), []
    for k in range(sessions * n):
        second = round(dice.uniform(0, 360), 1)  # ties
        kind = dice.choices(["moveEnd", "moveStart", "settingChange", "frame", "request", "ready", "selected"], [3, 1, 1, 12, 5, 4, 4])[0]
        uri = dice.choice(["a", "b", "c", "d", None]) if kind in ("request", "ready", "selected") else None
        frame = kind == "frame"
        out.append((k % sessions, at(second), k, kind, dice.random() < 0.7 if frame and dice.random() < 0.9 else None, dice.random() < 0.3 if frame else None, uri, dice.choice([None, 0, 7, 9]), int(second // 60) + dice.choice([0, 0, 1, 2])))
    return out


def test_any_order_within_the_delay_and_restarts_give_the_batch_result(spark):
    events = spark.createDataFrame([*made(), (None, at(3), 1, "moveEnd", None, None, None, None, 0), (1, None, 2, "moveEnd", None, None, None, None, 0)], SCHEMA)
    found = feed(spark, events, [[0, 1, 2], [3, 4], [5, 6, 7]], folder(spark), "150 seconds")
    same(found, events.where("session is not null and ts is not null"))


def test_an_event_later_than_the_delay_is_dropped(spark):
    early = [(1, at(s), s, kind, settled, None, None, None, 0) for s, kind, settled in [(1, "moveEnd", None), (2, "frame", True), (3, "frame", True), (30, "moveEnd", None), (31, "frame", False)]]
    after = [(1, at(100), 100, "frame", True, True, None, None, 1), (1, at(101), 101, "frame", True, None, None, None, 2)]
    late = [(1, at(32), 7, "moveEnd", None, None, None, None, 3), (1, at(95), 8, "request", None, None, "x", 5, 3)]
    events = spark.createDataFrame(early + after + late, SCHEMA)
    found = feed(spark, events, [[0, 1], [2, 3]], folder(spark), "10 seconds")
    same(found, events.where("event_id <> 7"))


def test_a_stream_without_events_has_no_rows(spark):
    events = spark.createDataFrame([], SCHEMA)
    cycles, contents = feed(spark, events, [[0]], folder(spark), "10 seconds")
    assert cycles.count() == 0 and contents.count() == 0


def test_settled_cycles_leave_the_state_and_no_key_goes_through_python(spark):
    rows = [(1, at(s), s, kind, settled, None, None, None, part) for s, kind, settled, part in [(1, "moveEnd", None, 0), (2, "frame", True, 0), (30, "moveEnd", None, 0), (31, "frame", False, 0), (100, "frame", True, 1)]]
    events, place = spark.createDataFrame(rows, SCHEMA), folder(spark)
    cycles, contents = feed(spark, events, [[0], [1]], place, "10 seconds")
    assert [r["event_id"] for r in spark.read.parquet(f"{place}/state/held/batch=1").orderBy("event_id").collect()] == [30, 31, 100]
    assert [r["cycle"] for r in spark.read.parquet(f"{place}/state/cycles").collect()] == [1]
    same((cycles, contents), events)
    assert "Python" not in cycles._jdf.queryExecution().toString()
