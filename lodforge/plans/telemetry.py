"""Queries of viewing telemetry; the twins spell the states out as windows of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodforge.functions import text as t
from lodforge.operators import telemetry as tel
from lodforge.plans import registry as r
from lodforge.sources import points as src

c = F.col
_B = "coalesce(nullif(transfer,0),nullif(encoded,0),nullif(decoded,0))"
_BASE = r._TIMING + """, camera AS (SELECT event_id, user_id AS session, ts, CASE event_type WHEN 'click' THEN 'moveEnd' WHEN 'signup' THEN 'moveStart' ELSE 'settingChange' END AS kind FROM events WHERE event_type IN ('click','signup','error')),
  frames AS (SELECT event_id, user_id AS session, ts, value AS frame_ms, CAST(round(value*100000) AS BIGINT) AS selected_points, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value*8000000 END AS memory_bytes, value/50 AS ratio FROM events)"""
_LEVELED = "leveled AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN uri ELSE printf('points/z%d/t%d.pnts', event_id % 5, event_id % 50) END AS lod FROM timing)"


@r.query("SELECT " + ", ".join(f"count(*) FILTER (WHERE lod LIKE 'points/z{k}/%.pnts') AS z{k}_requests, CAST(coalesce(sum({_B}) FILTER (WHERE lod LIKE 'points/z{k}/%.pnts'), 0) AS BIGINT) AS z{k}_bytes" for k in range(5)) + " FROM leveled", f"{_BASE}, {_LEVELED}")
def requests_by_level(spark, sf):
    """Requests of which two thirds go to numbered levels."""
    own = F.format_string("points/z%d/t%d.pnts", c("event_id") % 5, c("event_id") % 50)
    return tel.requests_by_level(src.timing(spark, sf).withColumn("uri", F.when(c("event_id") % 3 == 0, c("uri")).otherwise(own)))


_ASOF = f"SELECT t.*, CASE WHEN p.phase = 'ready' THEN 'refining' ELSE p.phase END AS phase FROM timing t ASOF JOIN (SELECT session, ts, arg_max(phase, event_id) AS phase FROM phases GROUP BY 1,2) p ON t.session = p.session AND t.ts >= p.ts"


@r.query(f"SELECT event_id, phase FROM ({_ASOF})", _BASE)
def phase_asof(spark, sf):
    return tel.phase_asof(src.timing(spark, sf), src.phases(spark, sf)).select("event_id", "phase")


@r.query(f"SELECT phase, count(*) AS requests, CAST(CASE WHEN count(*) = count(b) THEN sum(b) END AS BIGINT) AS bytes FROM (SELECT phase, CASE WHEN phase = 'travel' AND event_id % 211 = 0 THEN NULL ELSE {_B} END AS b FROM ({_ASOF})) GROUP BY 1", _BASE)
def phase_metrics(spark, sf):
    """A few requests of one phase come without any size."""
    phases, rows = src.phases(spark, sf), src.timing(spark, sf)
    unsized = tel.phase_asof(rows, phases).withColumns({k: F.when(~((c("phase") == "travel") & (c("event_id") % 211 == 0)), c(k)) for k in ("transfer", "encoded", "decoded")})
    return tel.sized_by_phase(unsized)


@r.query("SELECT session, count(DISTINCT uri) AS tiles, least(CAST(floor(count(DISTINCT uri) * (SELECT sum(encoded) FROM timing) / (SELECT count(DISTINCT uri) FROM timing)::DOUBLE + 0.5) AS BIGINT), (SELECT CAST(sum(encoded) AS BIGINT) FROM timing)) AS estimated FROM timing GROUP BY 1", _BASE)
def points_per_tile(spark, sf):
    rows = src.timing(spark, sf)
    whole = rows.agg(F.sum("encoded").alias("points"), F.count_distinct("uri").alias("all_tiles"))  # one row
    loaded = rows.groupBy("session").agg(F.count_distinct("uri").alias("loaded")).crossJoin(F.broadcast(whole))
    return tel.estimate_points(loaded, c("points"), c("all_tiles").cast("double")).select("session", c("loaded").alias("tiles"), "estimated")


_SELECTED = """selected AS (SELECT event_id, session, ts, uri, CASE WHEN uri LIKE 'points/z0/%' THEN 'overview' WHEN event_id % 7 IN (1,2,3) THEN 'internal' WHEN event_id % 7 IN (4,5) THEN 'leaf' END AS kind,
  CASE WHEN uri LIKE 'points/z0/%' THEN 'p001' WHEN event_id % 7 <> 6 THEN concat('d', event_id % 7) END AS level, CASE WHEN event_id % 97 <> 5 THEN encoded END AS points, decoded AS builder_points FROM timing)"""


def selected(spark, sf):
    """Each request read as a tile drawn: its kind, level, points at run time (some unknown) and as built."""
    k = c("event_id") % 7
    overview = t.parse_node_uri(c("uri"))[3]
    return src.timing(spark, sf).select(
        "event_id", "session", "ts", "uri", F.when(overview, "overview").when(k.isin(1, 2, 3), "internal").when(k.isin(4, 5), "leaf").alias("kind"), F.when(overview, "p001").when(k != 6, F.concat(F.lit("d"), k.cast("string"))).alias("level"),
        F.when(c("event_id") % 97 != 5, c("encoded")).alias("points"), c("decoded").alias("builder_points"))


_TOTAL = "CASE WHEN count(*) = count(points) THEN sum(points) END"


@r.query("SELECT session, " + ", ".join(f"CAST(coalesce(sum(points) FILTER (WHERE kind = '{k}'), 0) AS BIGINT) AS {k}" for k in tel.KINDS) + f", CAST({_TOTAL} AS BIGINT) AS total, count(*) FILTER (WHERE kind IS NULL) AS unknown, "
         + ", ".join(f"round(100.0::DOUBLE * coalesce(sum(points) FILTER (WHERE kind = '{k}'), 0) / nullif({_TOTAL}, 0), 6) AS {k}_percent" for k in tel.KINDS) + " FROM selected GROUP BY 1", f"{_BASE}, {_SELECTED}")
def selected_ownership(spark, sf):
    rows = tel.ownership_summary(selected(spark, sf))
    return rows.withColumns({f"{k}_percent": r._r(c(f"{k}_percent")) for k in tel.KINDS})


@r.query("SELECT session, level, count(*) AS tiles, CAST(coalesce(sum(points), 0) AS BIGINT) AS points, CAST(coalesce(sum(sum(points)) FILTER (WHERE level IS NOT NULL) OVER (PARTITION BY session), 0) - coalesce(sum(sum(points)) OVER (PARTITION BY session), 0) AS BIGINT) AS delta FROM selected GROUP BY 1,2", f"{_BASE}, {_SELECTED}")
def selected_level_points(spark, sf):
    return tel.selected_by_level(selected(spark, sf))


@r.query("SELECT session, CAST(CASE WHEN count(*) FILTER (WHERE points IS NULL OR builder_points IS NULL) = 0 THEN sum(builder_points) - sum(points) END AS BIGINT) AS delta FROM selected GROUP BY 1", f"{_BASE}, {_SELECTED}")
def reconciliation_delta(spark, sf):
    return tel.reconcile(selected(spark, sf))


@r.query("""SELECT event_id AS tile_id, CASE WHEN event_id % 4 = 0 AND kind IS NOT NULL THEN concat('own-', kind) WHEN uri IS NOT NULL THEN known END AS diagnostics, CASE WHEN event_id % 4 = 0 AND kind IS NOT NULL THEN 'runtime-extras' WHEN known IS NOT NULL THEN 'metadata-map' ELSE 'unavailable' END AS source,
  CASE WHEN (event_id % 4 = 0 AND kind IS NOT NULL) OR known IS NOT NULL THEN NULL WHEN uri IS NULL THEN 'missing-uri' ELSE 'missing-metadata' END AS reason
  FROM (SELECT event_id, kind, CASE WHEN event_id % 13 <> 1 THEN s.uri END AS uri, CASE WHEN event_id % 13 <> 1 AND NOT (event_id % 4 = 0 AND kind IS NOT NULL) THEN m.known END AS known FROM selected s LEFT JOIN (SELECT DISTINCT uri, concat('of ', uri) AS known FROM selected WHERE level IN ('d1', 'd2', 'd3')) m ON m.uri = s.uri)""", f"{_BASE}, {_SELECTED}")
def diagnostics_lookup(spark, sf):
    rows = selected(spark, sf)
    known = rows.where(c("level").isin("d1", "d2", "d3")).select("uri", F.concat(F.lit("of "), "uri").alias("diagnostics")).distinct()
    tiles = rows.select(c("event_id").alias("tile_id"), F.when(c("event_id") % 13 != 1, c("uri")).alias("uri"), F.when(c("event_id") % 4 == 0, F.concat(F.lit("own-"), "kind")).alias("inline"))
    return tel.resolve_diagnostics(tiles, known).select("tile_id", "diagnostics", "source", "reason")


_TAGGED = "concat(uri, '?u=', session % 50)"


@r.query(f"SELECT uri, CASE WHEN max(a) + max(b) = 2 THEN 'both' WHEN max(a) = 1 THEN 'timing-only' ELSE 'runtime-only' END AS status FROM (SELECT {_TAGGED} AS uri, 1 AS a, 0 AS b FROM timing WHERE event_id % 3 = 0 UNION ALL SELECT {_TAGGED}, 0, 1 FROM timing WHERE event_id % 5 = 1) GROUP BY 1", _BASE)
def timing_runtime_reconcile(spark, sf):
    rows = src.timing(spark, sf).select("event_id", F.concat("uri", F.lit("?u="), (c("session") % 50).cast("string")).alias("uri"))
    return tel.reconcile_requests(rows.where("event_id % 3 = 0"), rows.where("event_id % 5 = 1"))


_CYCLED = """cycled AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE o = 0) OVER w AS cycle, max(CASE WHEN o = 0 THEN ts END) OVER w AS stopped FROM (SELECT session, ts, 0 AS o, event_id, NULL AS uri, NULL AS transfer, NULL AS encoded, NULL AS decoded FROM camera WHERE kind = 'moveEnd'
  UNION ALL SELECT session, ts, 1, event_id, uri, transfer, encoded, decoded FROM timing) WINDOW w AS (PARTITION BY session ORDER BY ts, o, event_id ROWS UNBOUNDED PRECEDING)) WHERE o = 1 AND cycle > 0)"""
_AFTER = "(epoch_us(ts) - epoch_us(stopped)) / 1000000.0::DOUBLE"


def _cycled(spark, sf):
    return tel.in_cycles(src.timing(spark, sf), src.camera(spark, sf))


_DEPTH = r"regexp_extract(uri, '/d(\d+)_q', 1)"


@r.query(f"SELECT session, cycle, round(min({_AFTER}), 6) AS first, round(min({_AFTER}) FILTER (WHERE {_DEPTH} = '5'), 6) AS first_d5, round(min({_AFTER}) FILTER (WHERE {_DEPTH} = '6'), 6) AS first_d6 FROM cycled GROUP BY 1,2", f"{_BASE}, {_CYCLED}")
def first_event_delay(spark, sf):
    rows = tel.first_delays(_cycled(spark, sf).withColumn("depth", t.parse_node_uri(c("uri"))[1].cast("int")))
    return rows.withColumns({k: r._r(c(k)) for k in ("first", "first_d5", "first_d6")})


MARKS = (3600.0, 86400.0, 604800.0)


@r.query("SELECT session, cycle, CAST(milestone AS DOUBLE) AS milestone, count(*) FILTER (WHERE s <= milestone) AS uris FROM (SELECT session, cycle, uri, min(" + _AFTER + ") AS s FROM cycled GROUP BY 1,2,3), (VALUES " + ", ".join(f"({m})" for m in MARKS) + ") m(milestone) GROUP BY 1,2,3", f"{_BASE}, {_CYCLED}")
def request_timeline(spark, sf):
    return tel.request_timeline(_cycled(spark, sf), list(MARKS))


@r.query("SELECT session, place, event_id, level FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS place FROM selected) WHERE place <= 8", f"{_BASE}, {_SELECTED}")
def active_samples(spark, sf):
    return tel.active_samples(selected(spark, sf)).select("session", c("place").cast("long").alias("place"), "event_id", "level")


_GAUGES = "gauged AS (SELECT *, CASE WHEN event_id % 6 > 1 THEN CASE WHEN event_id % 9 = 2 THEN 3 ELSE 0 END END AS pending, CASE WHEN event_id % 6 > 2 THEN CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END END AS processing FROM frames)"
_SETTLED = "(pending IS NOT NULL OR processing IS NOT NULL) AND coalesce(pending, 0) = 0 AND coalesce(processing, 0) = 0"


def _gauges():
    k = c("event_id")
    return F.array(F.when(k % 6 > 1, F.when(k % 9 == 2, 3).otherwise(0)), F.when(k % 6 > 2, F.when(k % 10 == 3, 1).otherwise(0)))


@r.query(f"SELECT event_id, {_SETTLED} AS settled FROM gauged", f"{_BASE}, {_GAUGES}")
def queue_settled(spark, sf):
    return src.frames(spark, sf).select("event_id", tel.settled(_gauges()).alias("settled"))


QUIET, TIMEOUT = 86400.0, 259200.0
_CYCLES = f"""rows0 AS (SELECT session, ts, epoch_us(ts)/1000000.0::DOUBLE AS s, 0 AS o, event_id, kind, NULL AS settled, NULL AS deep FROM camera UNION ALL SELECT session, ts, epoch_us(ts)/1000000.0::DOUBLE, 1, event_id, 'frame', {_SETTLED}, event_id % 8 = 0 FROM gauged),
  rows1 AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE kind = 'moveEnd') OVER (PARTITION BY session ORDER BY ts, o, event_id ROWS UNBOUNDED PRECEDING) AS cycle FROM rows0) WHERE cycle > 0),
  rows2 AS (SELECT *, count(*) FILTER (WHERE kind IN ('moveStart','settingChange')) OVER w AS moved, count(*) FILTER (WHERE kind = 'frame' AND NOT settled) OVER w AS run, first(s) OVER w AS stopped FROM rows1 WINDOW w AS (PARTITION BY session, cycle ORDER BY ts, o, event_id ROWS UNBOUNDED PRECEDING)),
  rows3 AS (SELECT *, kind = 'frame' AND coalesce(settled, false) AND moved = 0 AND s - min(CASE WHEN kind = 'frame' AND settled THEN s END) OVER (PARTITION BY session, cycle, run ORDER BY ts, o, event_id ROWS UNBOUNDED PRECEDING) >= {QUIET} AS done FROM rows2),
  rows4 AS (SELECT *, kind = 'frame' AND moved = 0 AND coalesce(count(*) FILTER (WHERE done) OVER (PARTITION BY session, cycle ORDER BY ts, o, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS live FROM rows3),
  ends AS (SELECT session, cycle, stopped, min(s) FILTER (WHERE done) AS completed, min(s) FILTER (WHERE kind IN ('moveStart','settingChange')) AS moved_at, min(s) FILTER (WHERE live AND deep) AS deep_at, min(s) FILTER (WHERE live AND s - stopped >= {TIMEOUT}) AS late_at FROM rows4 GROUP BY 1,2,3),
  cycles AS (SELECT session, cycle, stopped, CASE WHEN completed IS NOT NULL THEN 'complete' WHEN closed IS NOT NULL THEN 'aborted' ELSE 'active' END AS status, closed, CASE WHEN deep_at <= coalesce(late_at, deep_at) THEN 'reached' WHEN late_at IS NOT NULL THEN 'timed-out' ELSE 'pending' END AS target
    FROM (SELECT *, coalesce(least(completed, moved_at), lead(stopped) OVER (PARTITION BY session ORDER BY cycle)) AS closed FROM ends))"""


def _cycles(spark, sf):
    frames = src.frames(spark, sf).select("session", "ts", "event_id", tel.settled(_gauges()).alias("settled"), (c("event_id") % 8 == 0).alias("deep"))
    return tel.cycles(src.camera(spark, sf), frames, QUIET, TIMEOUT)


@r.query("SELECT session, cycle, round(stopped, 3) AS stopped, status, round(closed, 3) AS closed, target FROM cycles", f"{_BASE}, {_GAUGES}, {_CYCLES}")
def refinement_cycles(spark, sf):
    """Sessions of the tables last days, so a day stands for the quiet span."""
    return _cycles(spark, sf).withColumns({k: r._r(c(k), 3) for k in ("stopped", "closed")})


_EVENTS = "CASE event_id % 4 WHEN 2 THEN 'ready' WHEN 3 THEN 'selected' ELSE 'request' END"
_LIFE = f"""life AS (SELECT session, cycle, uri, count(*) FILTER (WHERE kind = 'request') AS requests, min(ts) FILTER (WHERE kind = 'request') AS first_request, max(ts) FILTER (WHERE kind = 'request') AS last_request, bool_or(kind = 'ready') AS ever_ready, bool_or(kind = 'selected') AS ever_selected,
  CAST(coalesce(sum(n) FILTER (WHERE kind = 'selected'), 0) AS BIGINT) AS frames, CAST(coalesce(sum(bytes) FILTER (WHERE kind = 'request'), 0) AS BIGINT) AS bytes FROM (SELECT session, cycle, uri, {_EVENTS} AS kind, ts, max({_B}) AS bytes, count(*) AS n FROM cycled GROUP BY 1,2,3,4,5) GROUP BY 1,2,3)"""


def _life(spark, sf):
    k = c("event_id") % 4
    return tel.lifecycle(_cycled(spark, sf).withColumns({"kind": F.when(k == 2, "ready").when(k == 3, "selected").otherwise("request"), "bytes": tel.request_bytes()}))


@r.query("SELECT * FROM life", f"{_BASE}, {_CYCLED}, {_LIFE}")
def content_lifecycle(spark, sf):
    return _life(spark, sf)


@r.query("SELECT session, cycle, count(*) FILTER (WHERE ever_ready AND NOT ever_selected) AS uris, CAST(coalesce(sum(bytes) FILTER (WHERE ever_ready AND NOT ever_selected), 0) AS BIGINT) AS bytes, CAST(sum(requests) AS BIGINT) AS attempts FROM life JOIN (SELECT session, cycle FROM cycles WHERE status <> 'active') USING (session, cycle) GROUP BY 1,2", f"{_BASE}, {_GAUGES}, {_CYCLES}, {_CYCLED}, {_LIFE}")
def ready_never_selected(spark, sf):
    return tel.ready_never_selected(_life(spark, sf), _cycles(spark, sf))


LONGEST = 172800.0


@r.query(f"""SELECT session, max(intervals) AS intervals, round(sum(gap * 0.8 ** back * CASE WHEN back = intervals - 1 THEN 1.0 ELSE 0.2 END::DOUBLE), 4) AS ema FROM (SELECT *, count(*) OVER (PARTITION BY session) AS intervals, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) - 1 AS back FROM (
  SELECT session, ts, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session ORDER BY ts, event_id)))/1000000.0::DOUBLE AS gap FROM frames) WHERE gap > 0 AND gap <= {LONGEST}) GROUP BY 1""", _BASE)
def frame_ema(spark, sf):
    return tel.frame_ema(src.frames(spark, sf), 0.8, LONGEST).withColumn("ema", r._r(c("ema"), 4))


_N, _F, _S = 0.75, 2.5, 0.1


@r.query(f"""SELECT event_id, CASE WHEN base = 'near' AND NOT high THEN 'near' WHEN base = 'far' AND NOT low THEN 'far' ELSE 'medium' END AS band FROM (
  SELECT event_id, first(st) OVER w AS base, bool_or(st IS NULL AND ratio BETWEEN {_N}*(1-{_S}) AND {_N}*(1+{_S})) OVER w AS low, bool_or(st IS NULL AND ratio BETWEEN {_F}*(1-{_S}) AND {_F}*(1+{_S})) OVER w AS high FROM (
   SELECT *, count(st) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY session ORDER BY ts, event_id) = 1 THEN CASE WHEN ratio <= {_N} THEN 'near' WHEN ratio <= {_F} THEN 'medium' ELSE 'far' END
      WHEN ratio < {_N}*(1-{_S}) THEN 'near' WHEN ratio > {_F}*(1+{_S}) THEN 'far' WHEN ratio > {_N}*(1+{_S}) AND ratio < {_F}*(1-{_S}) THEN 'medium' END AS st FROM frames)) WINDOW w AS (PARTITION BY session, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""", _BASE)
def band_hysteresis(spark, sf):
    return tel.bands(src.frames(spark, sf)).select("event_id", "band")


_MIB = 1024 * 1024
_OVER = lambda points, memory, ms: f"(coalesce(selected_points > {points}, false) OR coalesce(memory_bytes > {memory}, false) OR coalesce(frame_ms > {ms}, false))"
_PRESSURE = f"""WITH RECURSIVE {_BASE}, placed AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS i, {_OVER("20e6", 1.3 * 1024 * _MIB, 80)} AS high, {_OVER("15e6", 1024.0 * _MIB, 50)} AS moderate,
  coalesce(selected_points < 12e6, true) AND coalesce(memory_bytes < {850.0 * _MIB}, true) AND coalesce(frame_ms < 40, true) AS calm FROM frames),
timed AS (SELECT session, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS us, CAST(NULL AS BIGINT) AS high, CAST(NULL AS BIGINT) AS moderate, CAST(NULL AS BIGINT) AS calm, 'NONE' AS level FROM placed WHERE i = 1
  UNION ALL SELECT session, i, event_id, us, h, m, q, CASE WHEN us - h >= 300000 THEN 'HIGH' WHEN us - m >= 500000 THEN 'MODERATE' WHEN us - q >= 1000000 THEN 'NONE' ELSE level END FROM (
    SELECT p.session, p.i, p.event_id, p.us, CASE WHEN p.high THEN coalesce(t.high, p.us) END AS h, CASE WHEN p.moderate THEN coalesce(t.moderate, p.us) END AS m, CASE WHEN p.calm THEN coalesce(t.calm, p.us) END AS q, t.level
    FROM timed t JOIN placed p ON p.session = t.session AND p.i = t.i + 1))
SELECT event_id, level FROM timed WHERE i > 0"""


@r.query(None)
def pressure_state(spark, sf):
    """The twin steps through each session's frames, one state after the other."""
    return tel.pressure(src.frames(spark, sf)).select("event_id", "level")


r.ORACLES["pressure_state"] = _PRESSURE

#: State: phase, since, due, whether a departure is open, and the changes told so far; times in microseconds.
_TIMELINE = """WITH RECURSIVE viewed AS (SELECT user_id AS session, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id % 4 > 0 AS flag, value * 400 AS distance,
  CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'depart' WHEN 'error' THEN 'arrive' WHEN 'click' THEN 'frame' ELSE CASE WHEN event_id % 3 = 0 THEN 'visible' ELSE 'request' END END AS kind FROM events),
walk AS (SELECT session, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS phase, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS due, false AS leaving, CAST([] AS STRUCT(moment BIGINT, phase VARCHAR)[]) AS told FROM viewed WHERE i = 1
  UNION ALL SELECT session, i, coalesce(entered, phase),
      CASE WHEN entered IS NOT NULL THEN NULL WHEN kind = 'frame' AND phase = 'refining' THEN CASE WHEN flag THEN coalesce(since, us) END ELSE since END,
      CASE WHEN kind = 'start' AND flag THEN us + 2500000 WHEN entered IS NOT NULL THEN NULL WHEN kind = 'arrive' AND phase = 'travel' AND leaving THEN us + 750000 ELSE due END,
      CASE WHEN kind IN ('start', 'arrive') THEN CASE WHEN kind = 'start' OR (phase = 'travel' AND leaving) THEN false ELSE leaving END WHEN kind = 'depart' AND phase IS NOT NULL THEN distance >= 10000 ELSE leaving END,
      list_concat(told, CASE WHEN entered IS NULL THEN CAST([] AS STRUCT(moment BIGINT, phase VARCHAR)[]) ELSE [struct_pack(moment := us, phase := entered)] END)
    FROM (SELECT *, CASE WHEN kind = 'start' THEN CASE WHEN flag THEN 'bootstrap' ELSE 'refining' END WHEN kind = 'visible' AND phase = 'bootstrap' THEN 'refining' WHEN kind = 'depart' AND phase IS NOT NULL AND distance >= 10000 THEN 'travel'
        WHEN kind = 'frame' AND phase = 'refining' AND flag AND us - since >= 1000000 THEN 'ready' WHEN kind = 'request' AND phase = 'ready' THEN 'refining' END AS entered
      FROM (SELECT v.session, v.i, v.us, v.kind, v.flag, v.distance, CASE WHEN w.due <= v.us THEN 'refining' ELSE w.phase END AS phase, CASE WHEN w.due <= v.us THEN NULL ELSE w.since END AS since,
          CASE WHEN w.due <= v.us THEN NULL ELSE w.due END AS due, w.leaving, CASE WHEN w.due <= v.us THEN list_append(w.told, struct_pack(moment := w.due, phase := 'refining')) ELSE w.told END AS told
        FROM walk w JOIN viewed v ON v.session = w.session AND v.i = w.i + 1) fired) stepped),
ends AS (SELECT session, CASE WHEN due IS NULL THEN told ELSE list_append(told, struct_pack(moment := due, phase := 'refining')) END AS told FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i DESC) AS k FROM walk) WHERE k = 1)
SELECT session, round(change.moment / 1000000.0::DOUBLE, 3) AS "at", change.phase AS phase FROM (SELECT session, unnest(told) AS change FROM ends)"""


@r.query(None)
def phase_timeline(spark, sf):
    """Each user's events read as one session: sign-ups start it, purchases depart, errors arrive, clicks are frames, views requests or first sight.

    The twin steps through each session's events, one state after the other.
    """
    e = src._events(spark, sf)
    kind = F.when(c("event_type") == "signup", "start").when(c("event_type") == "purchase", "depart").when(c("event_type") == "error", "arrive").when(c("event_type") == "click", "frame").otherwise(F.when(c("event_id") % 3 == 0, "visible").otherwise("request"))
    told = tel.phase_timeline(e.select(c("user_id").alias("session"), "ts", "event_id", kind.alias("kind"), (c("event_id") % 4 > 0).alias("flag"), (c("value") * 400).alias("distance")))
    return told.withColumn("at", r._r(c("at"), 3))


r.ORACLES["phase_timeline"] = _TIMELINE
