"""Viewing telemetry: selections, requests by cycle, and states over ordered frames as running values over slices
of the order (``ordered``), never as folds over collected groups, so a session may hold any share of the rows.

Rows of a session are ordered by (ts, event_id). Times are timestamps; limits are seconds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import SLICE, running, sliced


def micros(ts: Column | str) -> Column:
    """Microseconds of a timestamp's wall clock since 1970; of one without a zone the same in any session."""
    at = F.col(ts) if isinstance(ts, str) else ts
    whole = F.unix_date(F.to_date(at)).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60
    return whole * 1000000 + (F.date_part(F.lit("second"), at) * 1000000).cast("long")


def seconds(ts: Column | str) -> Column:
    """``micros`` in seconds, as a double."""
    return micros(ts) / 1e6


def span(limit: float) -> int:
    """Seconds as whole microseconds, so that a limit met exactly counts."""
    return round(limit * 1e6)


def request_bytes() -> Column:
    """Transferred bytes, else encoded, else decoded; null if none is known."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in ("transfer", "encoded", "decoded")])


def requests_by_level(timing: DataFrame, levels: int = 5) -> DataFrame:
    """One row: ``z<k>_requests`` and ``z<k>_bytes`` of content requests for each pyramid level."""
    level = F.regexp_extract("uri", r"(?:^|/)points/z(\d+)/.*\.pnts$", 1)
    return timing.agg(*[v for k in range(levels) for v in (F.count_if(level == str(k)).alias(f"z{k}_requests"), F.coalesce(F.sum(F.when(level == str(k), F.coalesce(request_bytes(), F.lit(0)))), F.lit(0)).alias(f"z{k}_bytes"))])


def phase_asof(requests: DataFrame, phases: DataFrame) -> DataFrame:
    """Each request, with all its columns, and the ``phase`` active at its start; those before the first phase go, ``ready`` counts as ``refining``.

    A phase that begins at the same time as a request is active.
    """
    marks = phases.select("session", "ts", F.lit(0).alias("o"), "event_id", "phase", F.lit(None).cast(requests.select(F.struct("*").alias("r")).schema["r"].dataType).alias("r"))
    asked = requests.select("session", "ts", F.lit(1).alias("o"), "event_id", F.lit(None).cast("string").alias("phase"), F.struct("*").alias("r"))
    order = ["ts", "o", "event_id"]
    active = running(sliced(marks.unionByName(asked), ["session"], order), ["session"], order, active=("last", F.col("phase"))).where("o = 1 and active is not null")
    return active.select("r.*", F.when(F.col("active") == "ready", "refining").otherwise(F.col("active")).alias("phase"))


def sized_by_phase(requests: DataFrame) -> DataFrame:
    """``phase``, ``requests``, ``bytes`` (null once the size of any of its requests is unknown) of what ``phase_asof`` gives."""
    rows = requests.withColumn("_b", request_bytes())
    return rows.groupBy("phase").agg(F.count("*").alias("requests"), F.when(F.count("*") == F.count("_b"), F.sum("_b")).alias("bytes"))


def estimate_points(loaded: DataFrame, points: Column, tiles: Column) -> DataFrame:
    """``loaded`` (tiles) with ``estimated``: its tiles times the mean points of a tile, never over the dataset's points; null without tiles."""
    return loaded.withColumn("estimated", F.least(F.floor(F.try_divide(F.col("loaded") * points, tiles) + 0.5).cast("long"), points))


KINDS = ("overview", "internal", "leaf")


def ownership_summary(selected: DataFrame, keys=("session",)) -> DataFrame:
    """Points of the selected tiles (kind, points) by kind, their total (null if any is unknown), shares in percent, and tiles of unknown kind."""
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("points"))), F.lit(0)).alias(k) for k in KINDS]
    total = F.when(F.count("*") == F.count("points"), F.sum("points")).alias("total")
    unknown = F.count_if(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).alias("unknown")
    rows = selected.groupBy(*keys).agg(*sums, total, unknown)
    return rows.select("*", *[F.try_divide(100.0 * F.col(k), F.col("total")).alias(f"{k}_percent") for k in KINDS])


def selected_by_level(selected: DataFrame, keys=("session",)) -> DataFrame:
    """``keys``, ``level`` (null for unclassified tiles), ``tiles``, ``points``, ``delta`` of the classified points to those of all tiles."""
    rows = selected.groupBy(*keys, "level").agg(F.count("*").alias("tiles"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"))
    w = Window.partitionBy(*keys)
    return rows.withColumn("delta", F.coalesce(F.sum(F.when(F.col("level").isNotNull(), F.col("points"))).over(w), F.lit(0)) - F.sum("points").over(w))


def reconcile(selected: DataFrame, keys=("session",), builder: str = "builder_points", runtime: str = "points") -> DataFrame:
    """``keys``, ``delta``: points that the builder wrote less those the runtime shows; null if any is unknown."""
    both = (F.count_if(F.col(builder).isNull() | F.col(runtime).isNull()) == 0)
    return selected.groupBy(*keys).agg(F.when(both, F.sum(builder) - F.sum(runtime)).alias("delta"))


def resolve_diagnostics(tiles: DataFrame, known: DataFrame) -> DataFrame:
    """``tiles`` (tile_id, uri, inline) with ``diagnostics`` and its ``source``: the tile's own, else that of ``known`` (uri, diagnostics), else none with a ``reason``.

    ``known`` has one row a uri.
    """
    rows = tiles.join(known.select(F.col("uri").alias("_u"), F.col("diagnostics").alias("_d")), F.col("uri") == F.col("_u"), "left")
    own, found = F.col("inline").isNotNull(), F.col("_u").isNotNull()
    reason = F.when(own | found, F.lit(None).cast("string")).when(F.col("uri").isNull(), "missing-uri").otherwise("missing-metadata")
    return rows.select(*[F.col(c) for c in tiles.columns], F.coalesce("inline", "_d").alias("diagnostics"), F.when(own, "runtime-extras").when(found, "metadata-map").otherwise("unavailable").alias("source"), reason.alias("reason"))


def reconcile_requests(timing: DataFrame, runtime: DataFrame, key: str = "uri") -> DataFrame:
    """``key``, ``status``: both, timing-only or runtime-only, for every value of either side; null is no value."""
    seen = timing.select(key, F.lit(1).alias("t"), F.lit(0).alias("r")).unionByName(runtime.select(key, F.lit(0).alias("t"), F.lit(1).alias("r"))).where(F.col(key).isNotNull())
    sides = seen.groupBy(key).agg(F.max("t").alias("t"), F.max("r").alias("r"))
    return sides.select(key, F.when(F.col("t") + F.col("r") == 2, "both").when(F.col("t") == 1, "timing-only").otherwise("runtime-only").alias("status"))


def in_cycles(events: DataFrame, camera: DataFrame) -> DataFrame:
    """``events`` with ``cycle`` and ``stopped``, the number and time of the session's last camera stop at or before them; earlier ones go."""
    kind = events.select(F.struct("*").alias("r")).schema["r"].dataType
    stops = camera.where("kind = 'moveEnd'").select("session", "ts", F.lit(0).alias("o"), "event_id", F.lit(None).cast(kind).alias("r"))
    every = stops.unionByName(events.select("session", "ts", F.lit(1).alias("o"), "event_id", F.struct("*").alias("r")))
    order, stop = ["ts", "o", "event_id"], F.col("o") == 0
    marked = running(sliced(every, ["session"], order), ["session"], order, cycle=("sum", stop.cast("long")), stopped=("last", F.when(stop, F.col("ts"))))
    return marked.where("o = 1 and cycle > 0").select("r.*", "cycle", "stopped")


def first_delays(events: DataFrame) -> DataFrame:
    """``session``, ``cycle`` and seconds from the stop to the first request, the first at depth 5 and at depth 6; ``events`` come from ``in_cycles`` and have ``depth``."""
    after = seconds("ts") - seconds("stopped")
    return events.groupBy("session", "cycle").agg(F.min(after).alias("first"), F.min(F.when(F.col("depth") == 5, after)).alias("first_d5"), F.min(F.when(F.col("depth") == 6, after)).alias("first_d6"))


def request_timeline(events: DataFrame, milestones: list[float]) -> DataFrame:
    """``session``, ``cycle``, ``milestone``, ``uris``: distinct content asked for within so many seconds of the stop."""
    first = events.groupBy("session", "cycle", "uri").agg(F.min(seconds("ts") - seconds("stopped")).alias("_s"))
    counts = first.groupBy("session", "cycle").agg(*[F.count_if(F.col("_s") <= m).alias(f"m{k}") for k, m in enumerate(milestones)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(m)).alias("milestone"), F.col(f"m{k}").alias("uris")) for k, m in enumerate(milestones)]))
    return counts.select("session", "cycle", rows.alias("m")).select("session", "cycle", "m.*")


def active_samples(selected: DataFrame, most: int = 8) -> DataFrame:
    """The first ``most`` selected tiles of each session by (ts, event_id), with ``place``."""
    place = F.row_number().over(Window.partitionBy("session").orderBy("ts", "event_id"))
    return selected.withColumn("place", place).where(F.col("place") <= most)


def settled(gauges: Column) -> Column:
    """All known gauges of an array are zero and at least one is known."""
    known = F.filter(gauges, lambda v: v.isNotNull())
    return (F.size(known) > 0) & F.forall(known, lambda v: v == 0)


def cycles(camera: DataFrame, frames: DataFrame, quiet: float = 0.25, timeout: float = 15.0) -> DataFrame:
    """One row a camera stop: ``session``, ``cycle``, ``stopped``, ``status`` (complete, aborted, active), ``closed``, ``target`` (reached, timed-out, pending).

    ``camera``: session, ts, event_id, kind; ``frames``: session, ts, event_id, settled, deep. A cycle ends when the camera moves
    or a setting changes (aborted), when the next stop comes (aborted) or once frames have been settled for ``quiet`` seconds
    (complete). The target is a deep frame before the end; without one it has timed out if a frame comes ``timeout`` seconds
    after the stop. At one time camera events come before frames.
    """
    marks = camera.select("session", "ts", F.lit(0).alias("o"), "event_id", "kind", F.lit(None).cast("boolean").alias("settled"), F.lit(None).cast("boolean").alias("deep"))
    shown = frames.select("session", "ts", F.lit(1).alias("o"), "event_id", F.lit("frame").alias("kind"), "settled", "deep")
    order, is_frame, own = ["ts", "o", "event_id"], F.col("kind") == "frame", ["session", "cycle"]
    calm = F.coalesce("settled", F.lit(False))
    rows = sliced(marks.unionByName(shown).withColumn("s", micros("ts")), ["session"], order)
    rows = running(rows, ["session"], order, cycle=("sum", (F.col("kind") == "moveEnd").cast("long"))).where("cycle > 0")
    moves = F.col("kind").isin("moveStart", "settingChange")
    rows = running(rows, own, order, moved=("sum", moves.cast("long")), run=("sum", (is_frame & ~calm).cast("long")), stopped=("min", F.col("s")))
    rows = running(rows, [*own, "run"], order, since=("min", F.when(is_frame & calm, F.col("s"))))
    rows = rows.withColumn("done", F.coalesce(is_frame & calm & (F.col("moved") == 0) & (F.col("s") - F.col("since") >= span(quiet)), F.lit(False)))
    rows = running(rows, own, order, before=True, ended=("sum", F.col("done").cast("long"))).withColumn("over", F.col("ended") + F.col("moved"))
    live = is_frame & (F.col("over") == 0)
    least = lambda condition: F.min(F.when(condition, F.col("s")))
    out = rows.groupBy("session", "cycle", "stopped").agg(
        least(F.col("done")).alias("completed"), least(F.col("kind").isin("moveStart", "settingChange")).alias("moved_at"), least(live & F.col("deep")).alias("deep_at"), least(live & (F.col("s") - F.col("stopped") >= span(timeout))).alias("late_at"),
    )
    following = out.select(F.col("session").alias("_of"), (F.col("cycle") - 1).alias("_before"), F.col("stopped").alias("following"))
    out = out.join(following, F.col("session").eqNullSafe(F.col("_of")) & (F.col("cycle") == F.col("_before")), "left")
    out = out.withColumn("closed", F.coalesce(F.least("completed", "moved_at"), "following"))
    status = F.when(F.col("completed").isNotNull(), "complete").when(F.col("closed").isNotNull(), "aborted").otherwise("active")
    target = F.when(F.col("deep_at") <= F.coalesce("late_at", "deep_at"), "reached").when(F.col("late_at").isNotNull(), "timed-out").otherwise("pending")
    return out.select("session", "cycle", (F.col("stopped") / 1e6).alias("stopped"), status.alias("status"), (F.col("closed") / 1e6).alias("closed"), target.alias("target"))


def lifecycle(events: DataFrame) -> DataFrame:
    """One row a cycle and uri of events (session, cycle, uri, ts, kind, bytes): requests, their first and last time, readiness, selection, bytes.

    ``kind`` is request, ready or selected. Requests of one uri at one time are one attempt.
    """
    asked = F.col("kind") == "request"
    one = events.groupBy("session", "cycle", "uri", "kind", "ts").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n"))
    return one.groupBy("session", "cycle", "uri").agg(
        F.count_if(asked).alias("requests"), F.min(F.when(asked, F.col("ts"))).alias("first_request"), F.max(F.when(asked, F.col("ts"))).alias("last_request"), F.bool_or(F.col("kind") == "ready").alias("ever_ready"),
        F.bool_or(F.col("kind") == "selected").alias("ever_selected"), F.coalesce(F.sum(F.when(F.col("kind") == "selected", F.col("n"))), F.lit(0)).alias("frames"), F.coalesce(F.sum(F.when(asked, F.col("bytes"))), F.lit(0)).alias("bytes"),
    )


def ready_never_selected(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """``session``, ``cycle``, ``uris`` and ``bytes`` that were ready but never drawn, and ``attempts`` of all content, per closed cycle."""
    unused = F.col("ever_ready") & ~F.col("ever_selected")
    sums = rows.groupBy("session", "cycle").agg(F.count_if(unused).alias("uris"), F.coalesce(F.sum(F.when(unused, F.col("bytes"))), F.lit(0)).alias("bytes"), F.sum("requests").alias("attempts"))
    return sums.join(closed.where("status <> 'active'").select("session", "cycle"), ["session", "cycle"])


def frame_ema(frames: DataFrame, keep: float = 0.8, longest: float = 0.25) -> DataFrame:
    """``session``, ``intervals``, ``ema`` (seconds): the smoothed time between frames after the last one.

    Intervals of zero or over ``longest`` seconds don't count, but the frame after one starts from it. The first interval enters
    whole. An interval maps the mean e to keep * e + (1 - keep) * gap; a slice composes its maps to one, and the slices' maps compose to the
    session's, whatever ``keep`` and however long the session. Sessions without an interval don't appear.
    """
    order = ["ts", "event_id"]
    rows = sliced(frames.select("session", "ts", "event_id", micros("ts").alias("s")), ["session"], order)
    gap = (F.col("s") - F.col("earlier")) / 1e6
    gaps = running(rows, ["session"], order, before=True, earlier=("last", F.col("s"))).withColumn("gap", gap).where((F.col("gap") > 0) & (F.col("gap") <= longest))
    back = F.row_number().over(Window.partitionBy(SLICE, "session").orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    maps = gaps.withColumn("back", back).groupBy(SLICE, "session").agg(
        F.count("*").alias("n"), F.sum(F.pow(F.lit(keep), F.col("back")) * (1 - keep) * F.col("gap")).alias("shift"), F.max_by("gap", "back").alias("first"))
    by = Window.partitionBy("session").orderBy(SLICE)
    later = F.coalesce(F.sum("n").over(by.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    whole = F.when(F.row_number().over(by) == 1, F.pow(F.lit(keep), F.col("n")) * F.col("first")).otherwise(0.0)
    parts = maps.select("session", "n", (F.pow(F.lit(keep), later) * (F.col("shift") + whole)).alias("part"))
    return parts.groupBy("session").agg(F.sum("n").alias("intervals"), F.sum("part").alias("ema"))


def bands(ratios: DataFrame, near: float = 0.75, far: float = 2.5, slack: float = 0.1) -> DataFrame:
    """``ratios`` (session, ts, event_id, ratio) with ``band``: near, medium or far, changed only beyond ``slack`` on either side of a threshold.

    A ratio clear of both zones, or the first, sets the band. Inside the lower zone near stays and far falls to medium, inside
    the upper one far stays and near rises to medium; so what counts since the last clear ratio is which zones came up. Null
    ratios go.
    """
    r, order = F.col("ratio"), ["ts", "event_id"]
    clear = F.when(r < near * (1 - slack), "near").when(r > far * (1 + slack), "far").when((r > near * (1 + slack)) & (r < far * (1 - slack)), "medium")
    first = F.when(r <= near, "near").when(r <= far, "medium").otherwise("far")
    rows = running(sliced(ratios.where(r.isNotNull()), ["session"], order), ["session"], order, before=True, _n=("sum", F.lit(1)))
    rows = rows.withColumn("_set", F.when(F.col("_n") == 0, first).otherwise(clear))
    rows = running(rows, ["session"], order, _g=("sum", F.col("_set").isNotNull().cast("int")), _base=("last", F.col("_set")))
    inside = lambda edge: (F.col("_set").isNull() & r.between(edge * (1 - slack), edge * (1 + slack))).cast("int")
    rows = running(rows, ["session", "_g"], order, _low=("max", inside(near)), _high=("max", inside(far)))
    base = F.col("_base")
    band = F.when((base == "near") & (F.col("_high") == 0), "near").when((base == "far") & (F.col("_low") == 0), "far").otherwise("medium")
    return rows.select(*ratios.columns, band.alias("band"))


MIB = 1024 * 1024


def pressure(frames: DataFrame) -> DataFrame:
    """``frames`` (session, ts, event_id, selected_points, memory_bytes, frame_ms) with ``level``: NONE, MODERATE or HIGH.

    A signal raises the level once it has held on every frame for 0.3 s (high) or 0.5 s (moderate); a full second below all
    lower limits takes it back to NONE; between, the last level stays. Unknown values give no signal and count as recovered.
    """
    names = ("selected_points", "memory_bytes", "frame_ms")
    over = lambda limits: F.greatest(*[F.coalesce(F.col(n) > v, F.lit(False)) for n, v in zip(names, limits, strict=True)])
    calm = F.least(*[F.coalesce(F.col(n) < v, F.lit(True)) for n, v in zip(names, (12e6, 850.0 * MIB, 40.0), strict=True)])
    order, signals = ["ts", "event_id"], {"_high": 0.3, "_moderate": 0.5, "_calm": 1.0}
    rows = frames.withColumns({"_high": over((20e6, 1.3 * 1024 * MIB, 80.0)), "_moderate": over((15e6, 1024.0 * MIB, 50.0)), "_calm": calm, "_s": micros("ts")})
    rows = running(sliced(rows, ["session"], order), ["session"], order, before=True, **{f"{k}_was": ("last", F.col(k)) for k in signals})
    begins = lambda k: F.when(F.col(k) & ~F.coalesce(F.col(f"{k}_was"), F.lit(False)), F.col("_s"))
    rows = running(rows, ["session"], order, **{f"{k}_since": ("last", begins(k)) for k in signals})
    held = {k: F.col(k) & (F.col("_s") - F.col(f"{k}_since") >= span(limit)) for k, limit in signals.items()}
    told = F.when(held["_high"], "HIGH").when(held["_moderate"], "MODERATE").when(held["_calm"], "NONE")
    rows = running(rows, ["session"], order, _level=("last", told))
    return rows.select(*frames.columns, F.coalesce("_level", F.lit("NONE")).alias("level"))


def phase_timeline(events: DataFrame, patience: float = 2.5, settle: float = 0.75, quiet: float = 1.0, far: float = 10_000.0) -> DataFrame:
    """``session``, ``at`` (seconds), ``phase``: every change of a session's viewing phase, those of timers after its last event too.

    ``events`` (session, ts, event_id, kind, flag, distance): ``start`` begins bootstrap, or refining where ``flag`` (a checked
    overview) isn't true; ``visible`` or ``patience`` seconds end bootstrap; ``depart`` over ``far`` or more begins travel, which ends
    ``settle`` seconds after its ``arrive``; a ``frame`` whose ``flag`` (all loaded) has held for ``quiet`` seconds of refining makes it
    ready; a ``request`` reopens refining. Events before a start, other kinds and rows without session or time change nothing.

    A start, and a departure over ``far`` after one, leave the same state whatever came before. They cut a session into segments that
    are independent of each other but for the time of the next one, so a session is spread over tasks; a segment's rows are sorted
    by Spark and streamed through one small state.
    """
    ordered = events.where(F.col("session").isNotNull() & F.col("ts").isNotNull()).select("session", micros("ts").alias("at"), "event_id", "kind", F.coalesce("flag", F.lit(False)).alias("flag"), F.coalesce(F.col("distance").cast("double"), F.lit(0.0)).alias("distance"))
    order = ["at", "event_id"]
    begins, departs = F.col("kind") == "start", (F.col("kind") == "depart") & (F.col("distance") >= far)
    rows = running(sliced(ordered, ["session"], order), ["session"], order, started=("max", begins.cast("int")))
    cuts = F.coalesce(begins | (departs & (F.col("started") == 1)), F.lit(False))
    rows = running(rows.withColumn("cut", cuts), ["session"], order, segment=("sum", F.col("cut").cast("long"))).where("segment > 0")
    following = rows.where("cut").select("session", (F.col("segment") - 1).alias("segment"), F.col("at").alias("until"))
    heads = rows.where("cut").join(following, ["session", "segment"], "left")
    dealt = heads.unionByName(rows.where("not cut"), True).select("session", "segment", "at", "event_id", F.expr("not cut").alias("later"), "kind", "flag", "distance", "until")
    dealt = dealt.repartition("session", "segment").sortWithinPartitions("session", "segment", "later", "at", "event_id")

    def fold(batches):
        session = segment = phase = since = due = until = None
        leaving = False
        changes: list[tuple] = []

        def enter(at, name, timer=None):
            nonlocal phase, since, due
            phase, since, due = name, None, timer
            changes.append((session, at / 1e6, name))

        def end():
            if due is not None and not due > (float("inf") if until is None or until != until else until):
                enter(due, "refining")

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.session != session or row.segment != segment:
                    end()
                    session, segment, until, phase, since, due, leaving = row.session, row.segment, row.until, None, None, None, False
                    if row.kind == "start":
                        enter(row.at, "bootstrap" if row.flag else "refining", row.at + span(patience) if row.flag else None)
                    else:
                        leaving = True
                        enter(row.at, "travel")
                    continue
                if due is not None and due <= row.at:
                    enter(due, "refining")
                if row.kind == "visible" and phase == "bootstrap":
                    enter(row.at, "refining")
                elif row.kind == "depart":
                    leaving = False
                elif row.kind == "arrive" and phase == "travel" and leaving:
                    due, leaving = row.at + span(settle), False
                elif row.kind == "frame" and phase == "refining":
                    if not row.flag:
                        since = None
                    elif since is None:
                        since = row.at
                    elif row.at - since >= span(quiet):
                        enter(row.at, "ready")
                elif row.kind == "request" and phase == "ready":
                    enter(row.at, "refining")
            if changes:
                yield pd.DataFrame(changes, columns=["session", "at", "phase"])
                changes.clear()
        end()
        if changes:
            yield pd.DataFrame(changes, columns=["session", "at", "phase"])

    return dealt.mapInPandas(fold, f"session {events.schema['session'].dataType.simpleString()}, at double, phase string")
