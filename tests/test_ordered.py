"""Running values of one frequent session over many slices against plain folds."""

import datetime as dt
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from lodforge.operators import ordered
from lodforge.operators import telemetry as tel
from lodforge.streaming.cycles import Cycle, Session

BEGAN = dt.datetime(2024, 5, 1)


@contextmanager
def many_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture
def slices(spark):
    with many_slices(spark):
        yield


def sessions(n, seed):
    """Most rows belong to session 1; some times are equal, one session is null, one has a single row."""
    dice = random.Random(seed)
    return [(1 if k % 10 else dice.choice([0, 2, None]), BEGAN + dt.timedelta(seconds=round(dice.uniform(0, n / 20), 1)), k, dice) for k in range(n)] + [(7, BEGAN, n, dice)]


def by_session(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_values_equal_folds(spark, slices):
    rows = [(s, ts, k, d.choice([None, d.randrange(-50, 50)])) for s, ts, k, d in sessions(5000, 1)]
    cut = ordered.sliced(spark.createDataFrame(rows, "session long, ts timestamp, event_id long, v long"), ["session"], ["ts", "event_id"])
    assert cut.where("session = 1").select(ordered.SLICE).distinct().count() >= 5
    folds = {"total": ("sum", F.col("v")), "least": ("min", F.col("v")), "most": ("max", F.col("v")), "newest": ("last", F.col("v"))}
    for before in (False, True):
        got = {r["event_id"]: tuple(r[n] for n in folds) for r in ordered.running(cut, ["session"], ["ts", "event_id"], before, **folds).collect()}
        for own in by_session(rows).values():
            seen = []
            for _, _, k, v in own:
                seen += [v] if v is not None and not before else []
                assert got[k] == (sum(seen), min(seen, default=None), max(seen, default=None), seen[-1] if seen else None)
                seen += [v] if v is not None and before else []
    assert ordered.running(cut.limit(0), ["session"], ["ts"], total=("sum", F.col("v"))).count() == 0


def test_bands_and_pressure_of_a_frequent_session(spark, slices):
    rows = [(s, ts, k, d.choice([None, *[d.uniform(0, 3.5)] * 9]), d.choice([None, d.randrange(10**6, 23 * 10**6)]), d.choice([None, d.uniform(0, 1.5e9)]), d.uniform(20, 95)) for s, ts, k, d in sessions(20000, 2)]
    frames = spark.createDataFrame(rows, "session long, ts timestamp, event_id long, ratio double, selected_points long, memory_bytes double, frame_ms double")
    band = {r["event_id"]: r["band"] for r in tel.bands(frames).collect()}
    level = {r["event_id"]: r["level"] for r in tel.pressure(frames).collect()}
    mib = 1024 * 1024
    for own in by_session(rows).values():
        now = held = None
        since, held = {}, "NONE"
        for _, ts, k, ratio, *values in own:
            if ratio is None:
                assert k not in band
            else:
                if now is None:
                    now = "near" if ratio <= 0.75 else "medium" if ratio <= 2.5 else "far"
                elif ratio < 0.75 * 0.9:
                    now = "near"
                elif ratio > 2.5 * 1.1:
                    now = "far"
                elif 0.75 * 1.1 < ratio < 2.5 * 0.9 or (now == "far" and ratio <= 0.75 * 1.1) or (now == "near" and ratio >= 2.5 * 0.9):
                    now = "medium"
                assert band[k] == now
            over = lambda *limits: any(v is not None and v > x for v, x in zip(values, limits, strict=True))  # noqa: B023, E731
            calm = all(v is None or v < x for v, x in zip(values, (12e6, 850 * mib, 40), strict=True))
            for name, on in (("high", over(20e6, 1.3 * 1024 * mib, 80)), ("moderate", over(15e6, 1024 * mib, 50)), ("calm", calm)):
                since[name] = since.get(name) or ts if on else None
            lasts = lambda name, span: since[name] is not None and (ts - since[name]).total_seconds() >= span - 1e-9  # noqa: B023, E731
            held = "HIGH" if lasts("high", 0.3) else "MODERATE" if lasts("moderate", 0.5) else "NONE" if lasts("calm", 1.0) else held
            assert level[k] == held
    assert len({*level.values()}) == 3 and len({*band.values()}) == 3


@pytest.mark.parametrize("keep", [0.5, 0.8, 0.99, 0.999])
def test_smoothed_frame_time_for_any_weight(spark, slices, keep):
    rows = [(s, ts, k) for s, ts, k, _ in sessions(4000, 3)]
    got = {r["session"]: (r["intervals"], r["ema"]) for r in tel.frame_ema(spark.createDataFrame(rows, "session long, ts timestamp, event_id long"), keep, 0.4).collect()}
    for session, own in by_session(rows).items():
        mean, n, last = None, 0, None
        for _, ts, _ in own:
            gap = (ts - last).total_seconds() if last else 0
            last = ts
            if 0 < gap <= 0.4 + 1e-9:
                mean, n = gap if mean is None else keep * mean + (1 - keep) * gap, n + 1
        assert (session in got) == (mean is not None)
        if mean is not None:
            assert got[session] == (n, pytest.approx(mean, rel=1e-9))


def test_phases_and_cycles_of_a_frequent_session(spark, slices):
    kinds = ["moveEnd", "moveStart", "settingChange"] + ["frame"] * 30
    rows = [(s, ts, k, d.choice(kinds), d.random() < 0.8, d.random() < 0.05) for s, ts, k, d in sessions(6000, 4) if s is not None]
    events = spark.createDataFrame(rows, "session long, ts timestamp, event_id long, kind string, settled boolean, deep boolean")
    camera, frames = events.where("kind <> 'frame'").select("session", "ts", "event_id", "kind"), events.where("kind = 'frame'").drop("kind")
    got = {(r["session"], r["cycle"]): (round(r["stopped"], 3), r["status"], r["closed"] and round(r["closed"], 3), r["target"]) for r in tel.cycles(camera, frames, 0.25, 3.0).collect()}
    numbered = {r["event_id"]: r["cycle"] for r in tel.in_cycles(frames, camera).collect()}
    active = {r["event_id"]: r["phase"] for r in tel.phase_asof(frames, camera.withColumnRenamed("kind", "phase")).collect()}
    expected = {}
    for session, own in by_session(rows).items():
        machine, phase = Session(Cycle(), lambda _: None, 0.25, 3.0), None
        for _, ts, k, kind, settled, deep in sorted(own, key=lambda r: (r[1], r[3] == "frame", r[2])):
            phase = phase if kind == "frame" else kind
            machine.take(round((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1e6), kind, settled, deep, None, 0)
            if kind == "frame":
                assert numbered.get(k, 0) == machine.cycle.cycle and active.get(k) == phase
        rest = {machine.cycle.cycle: machine.cycle.row()} if machine.cycle.cycle else {}
        for cycle, row in {**machine.closed, **rest}.items():
            second = lambda v: None if v is None else round(v / 1e6, 3)
            expected[session, cycle] = (second(row["stopped"]), row["status"], second(row["closed"]), row["target"])
    assert got == expected
    assert {"aborted", "complete"} <= {s for _, s, _, _ in got.values()}


def test_phase_timeline_of_a_frequent_session(spark, slices):
    kinds = ["start", "visible", "depart", "depart", "arrive", "arrive", "request"] + ["frame"] * 12
    rows = [(s, ts, k, d.choice(kinds), d.random() < 0.9, d.choice([5e3, 2e4])) for s, ts, k, d in sessions(6000, 5) if s is not None]
    events = spark.createDataFrame(rows, "session long, ts timestamp, event_id long, kind string, flag boolean, distance double")
    got = sorted((r["session"], round(r["at"], 3), r["phase"]) for r in tel.phase_timeline(events, patience=0.4, settle=0.3, quiet=0.2).collect())
    expected = []
    for session, own in by_session(rows).items():
        phase = since = due = None
        leaving = False
        for _, ts, _, kind, flag, distance in own:
            at = round((ts - BEGAN).total_seconds(), 3)
            told = lambda when, name: expected.append((session, round((BEGAN - dt.datetime(1970, 1, 1)).total_seconds() + when, 3), name))  # noqa: B023, E731
            if due is not None and due <= at + 1e-9:
                told(due, "refining")
                phase, since, due = "refining", None, None
            if kind == "start":
                phase, since, due, leaving = "bootstrap" if flag else "refining", None, at + 0.4 if flag else None, False
                told(at, phase)
            elif kind == "depart" and phase:
                leaving = distance >= 1e4
                if leaving:
                    phase, since, due = "travel", None, None
                    told(at, phase)
            elif kind == "arrive" and phase == "travel" and leaving:
                due, leaving = at + 0.3, False
            elif kind == "frame" and phase == "refining":
                since = (since if since is not None else at) if flag else None
                if since is not None and at - since >= 0.2 - 1e-9:
                    phase, since = "ready", None
                    told(at, phase)
            elif (kind == "visible" and phase == "bootstrap") or (kind == "request" and phase == "ready"):
                phase, since, due = "refining", None, None
                told(at, phase)
        if due is not None:
            told(due, "refining")
    assert got == sorted(expected)
