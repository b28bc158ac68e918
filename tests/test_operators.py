"""Hand cases of operators: nulls, ties, repeated rows, empty tables, clashing columns, faults."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodforge.functions import geometry as g
from lodforge.functions import text as t
from lodforge.operators import areas, audit, chunks, ledgers, pyramid, reports, sampling, telemetry, walks
from lodforge.operators.work import folder, once, written
from lodforge.sources import files, payloads
from lodforge.sources.points import read_points, with_ordinal
from lodforge.streaming.chunks import finalize_cells, stream_chunks

START = datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_ordinals_with_null_and_tied_keys(spark):
    frame = spark.createDataFrame([(None, "a", 9), (5, "b", 9), (6, "c", 9), (5, "d", 9), (None, "e", 9)], "k long, v string, ordinal int")
    found = sorted((r["ordinal"], r["k"]) for r in with_ordinal(frame, ["k"]).collect())
    assert found == [(0, None), (1, None), (2, 5), (3, 5), (4, 6)]
    assert with_ordinal(frame.limit(0), ["k"]).count() == 0
    many = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(13)
    assert [r["ordinal"] for r in with_ordinal(many, ["k"]).orderBy("k").collect()] == list(range(5000))


def test_sources_are_read_in_name_order_with_common_colours(spark):
    coloured = spark.createDataFrame([(1.0, 2.0, 3.0, 4, 5, 6, "A")], "x double, y double, z double, red int, green int, blue int, crs string")
    plain = spark.createDataFrame([(0.0, 0.0, 9.0, "A")], "x double, y double, z double, crs string")
    whole, meta = read_points([coloured, plain], ["b", "a"])
    assert whole.columns == ["x", "y", "z", "crs", "chunk_id"] and [r["chunk_id"] for r in whole.collect()] == ["a", "b"]
    assert tuple(meta.first()) == (2, 0.0, 0.0, 3.0, 1.0, 2.0, 9.0, False, "A", True)
    assert not read_points([coloured, plain.drop("crs")], ["b", "a"])[1].first()["one_crs"]
    assert read_points([coloured], ["b"])[1].first()["has_rgb"]


@pytest.mark.parametrize("uri, told", [("a\\b\\c.pnts", "a/b/c.pnts"), ("/x/y.pnts", "x/y.pnts"), ("./a/b", "a/b"), ("https://t/x/a.pnts?c=1", "/x/a.pnts"), ("../../points/d.pnts", "relative:../../points/d.pnts"), (None, None), ("", ""), ("a#b?c", "a")])
def test_canonical_uri(spark, uri, told):
    assert spark.createDataFrame([(uri,)], "u string").select(t.canonical_uri(F.col("u"))).first()[0] == told


@pytest.mark.parametrize("uri, old, new, told", [("c.pnts", "a/b", "a/b", "c.pnts"), ("../c.pnts", "a/b", "", "a/c.pnts"), ("c", "", "x/y", "../../c"), ("../../../c", "a/b", "a", None), ("/c", "a", "b", "/c"), (None, "a", "b", None)])
def test_rebased_uri(spark, uri, old, new, told):
    assert spark.createDataFrame([(uri, old, new)], "u string, o string, n string").select(t.rebase_uri(F.col("u"), F.col("o"), F.col("n"))).first()[0] == told


def test_squares_with_overlap(spark):
    p = spark.createDataFrame([(0.0, 5.0, 1), (9.0, 5.0, 2), (None, 1.0, 3)], "x double, y double, cx int")
    assert rows(chunks.spatial_chunk(p, 10.0).select("x", "cx", "cy", "is_buffer")) == [(0.0, 0, 0, False), (9.0, 0, 0, False)]
    assert rows(chunks.spatial_chunk(p, 10.0, buffer=2.0).select("x", "cx", "is_buffer")) == [(0.0, -1, True), (0.0, 0, False), (9.0, 0, False), (9.0, 1, True)]
    path = folder(spark)
    chunks.write_chunks(chunks.spatial_chunk(p, 10.0), path)
    assert spark.read.parquet(path).where("cx = 0").count() == 2


def test_pruning_thinning_merging_choosing(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0, 1), ("a", 1.0, 1.0, 2), ("b", 5.0, 5.0, 3)], "chunk_id string, x double, y double, ordinal long")
    box = spark.createDataFrame([(1.0, 1.0, 2.0, 2.0)], "low_x double, low_y double, high_x double, high_y double")
    assert rows(chunks.prune(chunks.chunk_stats(p), box)) == [("a",)] and chunks.prune(chunks.chunk_stats(p), box.limit(0)).count() == 0
    assert rows(chunks.decimate(p, 2).select("ordinal")) == [(1,), (3,)]
    assert rows(chunks.consolidate([p.select("x"), p.select("y")]).where("x is null").select("y")) == [(0.0,), (1.0,), (5.0,)]
    assert rows(chunks.select_chunks(p.select("chunk_id").distinct(), p.where("chunk_id = 'a'"), 5)) == [("b",)]


def test_audit_counts_each_fault(spark):
    e = spark.createDataFrame([(k, 0, 0, "adaptive") for k in range(6)], "ordinal long, ix int, iy int, role string")
    o = spark.createDataFrame([(0, 0, 0, "adaptive", 1.0, 1.0), (1, 0, 0, "adaptive", 1.0, 1.0), (1, 0, 0, "adaptive", 1.0, 1.0), (2, 1, 0, "adaptive", 1.0, 1.0), (3, 0, 0, "p001", 1.0, 1.0), (4, 0, 0, "adaptive", 50.0, 1.0), (99, 7, 7, "p001", 75.0, 75.0)], "ordinal long, ix int, iy int, role string, x double, y double")
    assert rows(audit.audit(e, o, 10.0, (0.0, 0.0))) == [(0, 0, 1, 1, 0, 1, 1, 2), (7, 7, 0, 0, 1, 0, 0, 0)]
    assert audit.audit(e.limit(0), o.limit(0), 10.0, (0.0, 0.0)).count() == 0
    assert rows(audit.role_gap(e, o)) == [(1, 2)] and rows(audit.role_gap(e.limit(0), e.limit(0))) == [(0, 0)]


def test_census_counts_invalid_points(spark):
    p = spark.createDataFrame([(1.0, 1.0, 1.0, 0, 0), (1.0, 1.0, None, 0, 0), (float("nan"), 1.0, 1.0, 1, 0), (1.0, float("inf"), 1.0, 0, 3)], "x double, y double, z double, ix int, iy int")
    assert rows(audit.z0_census(p)) == [(0, 0, 1, 4, 3)] and audit.z0_census(p.limit(0)).count() == 0


def test_drift_of_ledgers(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", None, 1), ("c", 3, 2), ("d", 4, 3)], "name string, size int, place int")
    new = spark.createDataFrame([("b", None, 0), ("c", 5, 1), ("d", 4, 3), ("e", 1, 2)], "name string, size int, place int")
    assert rows(audit.source_drift(old, new, "name", ["size"], "place")) == [("a", "removed"), ("b", "reordered"), ("c", "changed"), ("d", "same"), ("e", "added")]


def test_extension(spark):
    census = spark.createDataFrame([(0, 0, 5, 12, 2), (1, 0, 4, 12, 2), (2, 0, 1, 12, 2)], "ix int, iy int, n long, visited long, invalid long")
    done = spark.createDataFrame([(0, 0), (9, 9)], "ix int, iy int")
    assert rows(audit.extension_cells(census, done).select("ix", "unknown")) == [(1, 1), (2, 1)]
    part = lambda ix, a: spark.createDataFrame([(ix, 0, 1, a)], "ix int, iy int, p001 long, adaptive long")
    assert rows(audit.merge_extension(part(0, 4), part(1, 3), census).select("p001", "adaptive", "visited", "invalid", "outside")) == [(2, 7, 12, 2, 1)]


def test_quota_cases(spark):
    occupancy = lambda counts: spark.createDataFrame([("n", k, v) for k, v in counts.items()], "node string, cell int, cnt long")
    allocated = lambda counts, quota: {r["cell"]: r["alloc"] for r in sampling.quota_allocation(occupancy(counts), quota).collect()}
    assert allocated({5: 10, 2: 10, 8: 10}, 2) == {5: 1, 2: 1, 8: 0}
    assert allocated({0: 1, 1: 1, 2: 10}, 12) == {0: 1, 1: 1, 2: 10} and allocated({0: 10, 1: 20}, 1000) == {0: 10, 1: 20}
    assert sampling.quota_allocation(occupancy({0: 1}).limit(0), 5).count() == 0


def test_pyramid_of_few_points(spark):
    p = spark.createDataFrame([(0, 1.0, 1.0, 0.0), (1, 60.0, 1.0, 10.0), (50, 1.0, 60.0, 20.0), (None, 1.0, 1.0, 1.0), (7, None, 1.0, 1.0)], "ordinal long, x double, y double, z double")
    cells = {(r["lvl"], r["ix"], r["iy"]): r["n"] for r in pyramid.pyramid_cells(p, (0.0, 0.0)).collect()}
    assert cells == {(0, 0, 0): 1, (1, 0, 0): 2, (2, 0, 0): 2, (3, 0, 0): 2, (4, 0, 0): 1, (4, 1, 0): 1, (4, 0, 1): 1}
    tiles = {(r["lvl"], r["ix"], r["iy"]): r for r in pyramid.pyramid(p, (0.0, 0.0)).collect()}
    assert tiles[4, 0, 0]["request"][3] == 375 and tiles[4, 0, 0]["request"][11] == 500 and tiles[3, 0, 0]["request"] is None
    assert pyramid.pyramid(p.limit(0), (0.0, 0.0)).count() == 0
    old = pyramid.pyramid_cells(p, (0.0, 0.0), pyramid.OLD_LEVELS)
    assert {(r["lvl"], r["ix"], r["iy"]): r["n"] for r in pyramid.upgrade_pyramid(old, p, (0.0, 0.0)).collect()} == cells


def test_profiles_and_ids(spark):
    assert pyramid.profile_match(pyramid.profile_rows(pyramid.LEVELS, spark), pyramid.profile_rows(pyramid.LEVELS, spark)).count() == 0
    assert pyramid.profile_match(pyramid.profile_rows(pyramid.OLD_LEVELS, spark), pyramid.profile_rows(pyramid.LEVELS, spark)).count() == 9
    ids = spark.createDataFrame([("z0_x000001_y-00002",), ("z0_x000001_y000001",), ("z0_x000001_y000001",), ("z1_x1_y1",), (None,)], "id string")
    assert rows(pyramid.check_ids(ids)) == [("z0_x000001_y000001", 2, True, False), ("z1_x1_y1", 1, False, True), (None, 1, False, True)]


def test_boxes(spark):
    box = spark.range(1).select(F.array(*[F.lit(float(v)) for v in (0, 0, 0, 30, 0, 0, 0, 40, 0, 0, 0, 1)]).alias("b"))
    assert box.select(g.request_box(F.col("b"), 2.0)).first()[0][11] == pytest.approx(2 * math.sqrt(30**2 + 40**2 + 1))
    assert box.select(g.request_box(F.transform("b", lambda v: v * 0), 2.0)).first()[0] is None
    moved = spark.range(1).select(*g.world_to_frame((F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(1.0)))).first()
    assert tuple(moved) == (1.0, 2.0, 3.0)
    up = spark.range(1).select(*g.octree_ancestor(F.lit(3), (F.lit(5), F.lit(-1), F.lit(0)), 1), *g.octree_ancestor(F.lit(0), (F.lit(5), F.lit(2), F.lit(0)), 1)).first()
    assert tuple(up) == (1, 1, -1, 0, 0, 5, 2, 0)


def test_reports(spark):
    names = "chunk_id string, " + ", ".join(f"{s} double" for s in reports.SIDES) + ", source_points long, emitted_points long, tiles long, has_rgb boolean, step int, crs string, error_before double, error_after double"
    two = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 10, 5, 1, None, 10, "A", 3.0, 2.0), ("b", -1.0, 0.0, 0.0, 0.5, 9.0, 1.0, 0, 0, 2, False, 10, None, 4.0, 1.0)], names)
    one = reports.chunk_rollup(two).first()
    assert (one["min_x"], one["max_y"], one["source_points"], one["has_rgb"], one["step"], one["crs"], one["error_before"]) == (-1.0, 9.0, 10, False, 10, "mixed", 4.0)
    assert reports.chunk_rollup(two.limit(0)).first()["source_points"] is None
    frames = spark.createDataFrame([("b", "globe", [1.0, 2.0], [3.0]), ("a", "globe", [1.0, 2.0], [3.0 + 5e-7]), ("c", "globe", [1.0], [3.0]), ("d", "local", None, None)], "chunk_id string, mode string, origin array<double>, transform array<double>")
    assert [(r["chunk_id"], r["agrees"], r["mixed"]) for r in reports.check_frames(frames).orderBy("chunk_id").collect()] == [("a", True, True), ("b", True, True), ("c", False, True), ("d", True, True)]
    usage = spark.createDataFrame([("m", "t", 15.0), ("m", "u", 3.0), ("n", "t", None)], "month string, kind string, amount double")
    tiers = spark.createDataFrame([("t", 0.0, 10.0, 0.0), ("t", 10.0, None, 2.0)], "kind string, low double, high double, price double")
    assert rows(reports.tiered_cost(usage, tiers)) == [("m", "t", 10.0), ("m", "u", 0.0), ("n", "t", 0.0)]


def test_frontier_and_its_faults(spark):
    tiles = spark.createDataFrame([("r", None, None), ("a", "r", "a.pnts"), ("b", "r", None), ("c", "b", "c.pnts"), ("d", "b", None), ("e", "a", "never.pnts")], "tile string, parent string, uri string")
    files_ = spark.createDataFrame([("a.pnts", 10)], "uri string, bytes long")
    branches, totals = walks.coarse_frontier(tiles, files_)
    assert rows(branches.select("tile", "depth", "problem")) == [("a", 1, None), ("c", 2, "missing"), ("d", 2, "empty")]
    assert tuple(totals.first()) == (1, 10, 1, 2, False)
    good = walks.coarse_frontier(tiles.where("tile in ('r', 'a')"), files_)[1].first()
    assert good["ready"] and not walks.coarse_frontier(tiles.limit(0), files_)[1].first()["ready"]
    with pytest.raises(ValueError):
        walks.coarse_frontier(spark.createDataFrame([("r", None, None)], "tile string, parent string, uri string").union(spark.createDataFrame([("x", "r", None), ("r", "x", None)], "tile string, parent string, uri string")), files_, 4)


def test_reachability_and_circles(spark):
    docs = spark.createDataFrame([("e",), ("a",), ("b",), ("c",), ("x",)], "doc string")
    refs = spark.createDataFrame([("e", "a"), ("a", "b"), ("b", "a"), ("e", "b"), ("x", "e"), ("b", "gone"), ("e", "a")], "src string, dst string")
    assert rows(walks.reachable(docs, refs, "e")) == [("a", 1, True), ("b", 1, True), ("c", None, False), ("e", 0, False), ("x", None, False)]


def test_documents_between_circles_are_on_none(spark):
    """Random graphs against reach by hand, with links to itself, repeats and nulls."""
    import random

    def circles(links):
        after = {}
        for a, b in links:
            after.setdefault(a, set()).add(b)
        out = set()
        for start in after:
            seen, todo = set(), [start]
            while todo:
                for b in after.get(todo.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            out |= {start} & seen
        return out

    dice = random.Random(1)
    for links in ([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d")], [("a", "a"), ("a", "b"), ("b", "c")], [(str(dice.randrange(40)), str(dice.randrange(40))) for _ in range(50)]):
        names = sorted({x for pair in links for x in pair} | {"z"})
        docs = spark.createDataFrame([(n,) for n in names], "doc string")
        refs = spark.createDataFrame([*links, *links[:2], (None, "a"), ("a", None)], "src string, dst string")
        found = {r["doc"]: r["cycle"] for r in walks.reachable(docs, refs, "a").collect()}
        assert {d for d, c in found.items() if c} == circles(links) and len(found) == len(names)


def test_octree_groups(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 0, 10), (1, 0, 0, 0, 10), (2, 0, 0, 0, 100), (2, 1, 1, 0, 100), (3, 7, 7, 7, 10)], "lvl int, kx int, ky int, kz int, points long")
    found = {tuple(r[:4]): tuple(r[5:]) for r in walks.octree_pack(nodes, 1, 2000).collect()}
    assert found == {(0, 0, 0, 0): (0, 0, 0, 0), (1, 0, 0, 0): (1, 0, 0, 0), (2, 0, 0, 0): (2, 0, 0, 0), (2, 1, 1, 0): (2, 1, 1, 0), (3, 7, 7, 7): (1, 1, 1, 1)}
    assert walks.octree_pack(nodes.limit(0), 1, 2000).count() == 0
    tree = {tuple(r[:4]): (r["parent"], r["children"]) for r in walks.octree_tree(nodes).collect()}
    assert tree[2, 1, 1, 0] == ("1-0-0-0", 0) and tree[1, 0, 0, 0] == ("0-0-0-0", 2) and tree[3, 7, 7, 7] == (None, 0)


def test_areas_few_and_many_agree(spark, monkeypatch):
    boxes = spark.range(40).selectExpr("concat('area-', id) area_id", "id * 5D min_x", "id * 5D + 8 max_x", "0D min_y", "10D max_y", "0D min_z", "5D max_z")
    samples = spark.range(300).selectExpr("id sample_id", "id % 20 view_id", "id * 0.7D x", "id % 12 * 1D y", "id % 7 * 1D z", "if(id % 2 = 0, 1D, 0.5D) weight")
    few = rows(areas.detect_area(samples, boxes))
    monkeypatch.setattr(areas, "FEW_AREAS", 3)
    assert rows(areas.detect_area(samples, boxes)) == few and len(few) == 20
    assert {r[5] for r in rows(areas.detect_area(samples, boxes.limit(0)))} == {"no_area_match"}


def frames(spark, values, names="frame_ms double"):
    return spark.createDataFrame([(1, at(s), k, v) for k, (s, v) in enumerate(values)], f"session long, ts timestamp_ntz, event_id long, {names}")


def plain_bands(ratios, near=0.75, far=2.5, slack=0.1):
    out, band = [], None
    for v in ratios:
        if band is None:
            band = "near" if v <= near else "medium" if v <= far else "far"
        elif band == "near":
            band = "far" if v > far * (1 + slack) else "medium" if v > near * (1 + slack) else "near"
        elif band == "medium":
            band = "near" if v < near * (1 - slack) else "far" if v > far * (1 + slack) else "medium"
        else:
            band = "near" if v < near * (1 - slack) else "medium" if v < far * (1 - slack) else "far"
        out.append(band)
    return out


def test_bands_equal_the_state_machine(spark):
    import random

    draw = random.Random(1)
    ratios = [draw.choice([0.1, 0.7, 0.75, 0.8, 1.5, 2.3, 2.5, 2.7, 4.0]) for _ in range(400)]
    found = telemetry.bands(frames(spark, list(enumerate(ratios)), "ratio double")).orderBy("event_id").collect()
    assert [r["band"] for r in found] == plain_bands(ratios)


def test_ema_equals_the_fold(spark):
    import random

    draw = random.Random(2)
    times = [0.0]
    for _ in range(600):
        times.append(times[-1] + draw.choice([0.016, 0.033, 0.1, 0.4, 0.0]))
    ema = None
    for a, b in zip(times, times[1:]):
        gap = round(b - a, 6)
        if 0 < gap <= 0.25:
            ema = gap if ema is None else 0.8 * ema + 0.2 * gap
    found = telemetry.frame_ema(frames(spark, [(s, 0.0) for s in times])).first()
    assert found["ema"] == pytest.approx(ema, abs=1e-6) and telemetry.frame_ema(frames(spark, [(0, 0.0)])).count() == 0


def test_pressure_levels(spark):
    f = spark.createDataFrame([(1, at(s), k, p, None, None) for k, (s, p) in enumerate([(0, 21e6), (0.2, 21e6), (0.31, 21e6), (1, 16e6), (1.6, 16e6), (2, 13e6), (3, 1e6), (3.5, 1e6), (4.1, 1e6)])], "session long, ts timestamp_ntz, event_id long, selected_points double, memory_bytes double, frame_ms double")
    assert [r["level"] for r in telemetry.pressure(f).orderBy("event_id").collect()] == ["NONE", "NONE", "HIGH", "MODERATE", "MODERATE", "MODERATE", "MODERATE", "MODERATE", "NONE"]


def test_cycles(spark):
    camera = spark.createDataFrame([(1, at(0), 0, "moveEnd"), (1, at(10), 1, "moveStart"), (1, at(11), 2, "moveEnd"), (1, at(40), 3, "moveEnd"), (2, at(0), 4, "moveStart")], "session long, ts timestamp_ntz, event_id long, kind string")
    shown = spark.createDataFrame([(1, at(1), 10, False, False), (1, at(12), 11, True, True), (1, at(12.1), 12, False, False), (1, at(13), 13, True, False), (1, at(13.3), 14, True, False), (1, at(60), 15, False, True), (2, at(5), 16, True, True)], "session long, ts timestamp_ntz, event_id long, settled boolean, deep boolean")
    base = telemetry.cycles(camera, shown).orderBy("cycle").collect()
    second = lambda v: None if v is None else round(v - base[0]["stopped"], 3)
    assert [(r["session"], r["cycle"], r["status"], second(r["closed"]), r["target"]) for r in base] == [(1, 1, "aborted", 10.0, "pending"), (1, 2, "complete", 13.3, "reached"), (1, 3, "active", None, "reached")]


def test_phases_and_sizes(spark):
    marks = spark.createDataFrame([(1, at(1), 0, "travel"), (1, at(5), 1, "ready")], "session long, ts timestamp_ntz, event_id long, phase string")
    asked = spark.createDataFrame([(1, at(0), 5, 1, 0, 0), (1, at(1), 6, 7, 0, 0), (1, at(2), 7, 0, 0, 0), (1, at(6), 8, 0, 9, 0)], "session long, ts timestamp_ntz, event_id long, transfer long, encoded long, decoded long")
    found = telemetry.phase_asof(asked, marks)
    assert rows(found.select("event_id", "phase")) == [(6, "travel"), (7, "travel"), (8, "refining")]
    assert rows(telemetry.sized_by_phase(found)) == [("refining", 1, 9), ("travel", 2, None)]
    assert telemetry.phase_asof(asked, marks.limit(0)).count() == 0


def test_settled_gauges(spark):
    values = [[0, None], [None, None], [0, 1], []]
    found = spark.createDataFrame([(v,) for v in values], "g array<int>").select(telemetry.settled(F.col("g"))).collect()
    assert [r[0] for r in found] == [True, False, False, False]


def test_ledgers(spark):
    refs = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "uri string")
    assert rows(ledgers.missing_content(refs, spark.createDataFrame([("b",)], "uri string"))) == [("a", 2), (None, 1)]
    f = spark.createDataFrame([(1, at(k), k, v) for k, v in enumerate([0, 5, 0, 0, 3, 0])] + [(2, at(0), 9, 0)], "session long, ts timestamp_ntz, event_id long, selected_points long")
    assert rows(ledgers.zero_runs(f)) == [(1, 2)]


def test_payloads_round_trip(spark):
    p = spark.createDataFrame([("u", k, 100.0 + k, 5.0, -k * 0.5, k, 2, None) for k in range(50)] + [("v", 0, 1.0, 1.0, 1.0, 1, 1, 1)], "uri string, ordinal long, x double, y double, z double, red int, green int, blue int")
    encoded = written(payloads.encode_pnts(p), "encoded")
    heads = {r["uri"]: r for r in payloads.read_pnts_headers(encoded).collect()}
    assert (heads["u"]["points"], heads["u"]["has_rgb"], heads["u"]["byte_length"] % 8, heads["v"]["center"]) == (50, True, 0, [1.0, 1.0, 1.0])
    back = {(r["uri"], r["place"]): r for r in payloads.read_pnts_points(encoded).collect()}
    assert len(back) == 51 and all(abs(back["u", k]["x"] - 100 - k) < 1e-4 and back["u", k]["red"] == k and back["u", k]["blue"] == 0 for k in range(50))
    broken = spark.createDataFrame([("w", bytearray(b"pnts")), ("n", None)], "uri string, payload binary")
    wanted = spark.createDataFrame([("u", 50, True), ("v", 2, True), ("w", 1, False), ("gone", 1, True)], "uri string, points long, has_rgb boolean")
    problems = payloads.validate_pnts(payloads.read_pnts_headers(encoded.select("uri", "payload").union(broken)), wanted)
    assert rows(problems) == [("gone", "missing"), ("v", "points"), ("w", "format")]
    assert payloads.encode_pnts(p.drop("blue").limit(0)).count() == 0


def test_documents_round_trip(spark):
    box = [0.0] * 12
    tiles = spark.createDataFrame([("d", "", None, 2.0, box, "r.pnts", '{"k":1}'), ("d", "0", "", 1.0, box, None, None), ("d", "03", "0", 0.0, box, "sub/tileset.json", None)], "doc string, path string, parent string, error double, box array<double>, uri string, extras string")
    docs = payloads.tile_documents(tiles)
    found = payloads.read_tile_documents(docs).select("place", "parent", "depth", "uri", "external")
    assert rows(found) == [("r", None, 0, "r.pnts", False), ("r/0", "r", 1, None, False), ("r/0/0", "r/0", 2, "sub/tileset.json", True)]
    assert payloads.variant_parity(tiles, tiles.where("path <> ''")).first()["side"] == "first"


def test_files(spark):
    path = folder(spark)
    spark.range(3).coalesce(1).write.json(path)
    found = files.fingerprints(spark, f"{path}/*.json").collect()
    assert len(found) == 1 and len(found[0]["sha256"]) == 64 and found[0]["salt"] == found[0]["dataset"][:16]
    metrics = files.source_metrics(spark, f"{path}/*.json", ["X", "Red", "Green", "Blue"], 'PROJCS["CH1903+",GEOGCS["x"]]').first()
    assert metrics["has_rgb"] and metrics["crs"] == "CH1903+" and metrics["bytes"] == found[0]["size"]


def test_streams_and_cells_resume(spark):
    base = folder(spark)
    put = lambda k: spark.createDataFrame([(k, v) for v in range(3)], "chunk_id string, v int").coalesce(1).write.mode("append").parquet(f"{base}/in")
    run = lambda: rows(stream_chunks(spark.readStream.schema("chunk_id string, v int").parquet(f"{base}/in"), f"{base}/state").select("chunk_id", "n", "first"))
    put("a")
    assert run() == run() == [("a", 3, 0)]
    put("b")
    assert run() == [("a", 3, 0), ("b", 3, 3)]
    p = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (1, 0, 3)], "ix int, iy int, v int")
    finalize_cells(p.where("ix = 0"), lambda d: d, f"{base}/cells")
    assert rows(finalize_cells(p, lambda d: d, f"{base}/cells")) == [(0, 0, 2, 1), (1, 0, 1, 2)]
    for _ in range(2):  # a cell without a result is done too
        assert rows(finalize_cells(p, lambda d: d.where("ix = 0"), f"{base}/empty")) == [(0, 0, 2, 1), (1, 0, 0, 1)]


def test_files_along_a_curve_are_pruned(spark):
    path = f"{folder(spark)}/curve"
    p = spark.range(8000).selectExpr("id ordinal", "id * 7919 % 1000 * 1D x", "id * 104729 % 997 * 1D y").unionAll(spark.sql("select 9000L, cast(null as double), 5D")).repartition(3)
    bounds = chunks.write_along_curve(p, path, 250)
    assert bounds.count() >= 33 and bounds.agg({"n": "sum"}).first()[0] == 8001
    for low, high in (((100.0, 100.0), (160.0, 150.0)), ((0.0, 0.0), (1000.0, 1000.0)), ((5.0, 5.0), (5.0, 500.0)), ((2000.0, 0.0), (3000.0, 1.0))):
        found, read = chunks.read_box(spark, path, low, high)
        assert rows(found) == rows(p.where(f"x between {low[0]} and {high[0]} and y between {low[1]} and {high[1]}"))
        assert read == 0 if low[0] == 2000 else read <= bounds.count() if high[0] == 1000 else 0 < read < bounds.count() / 2
    assert chunks.write_along_curve(p.limit(0), path).count() == 0 and chunks.read_box(spark, path, (0.0, 0.0), (1.0, 1.0))[0].count() == 0


def test_written_once(spark):
    calls = []
    build = lambda: calls.append(1) or spark.range(4)
    assert once(spark, ("few", "x"), build).count() == once(spark, ("few", "x"), build).count() == 4 and len(calls) == 1


def test_phase_timeline(spark):
    steps = [
        (1, -1, "frame", True, None), (1, 0, "start", True, None), (1, 1, "visible", None, None), (1, 2, "frame", True, None), (1, 2.5, "frame", False, None), (1, 3, "frame", True, None), (1, 4, "frame", True, None),
        (1, 5, "request", None, None), (1, 6, "depart", None, 9999.0), (1, 7, "depart", None, 10000.0), (1, 8, "arrive", None, None), (1, 8.5, "depart", None, 1.0), (1, 8.6, "arrive", None, None), (1, 9, "frame", True, None), (1, 10, "frame", True, None),
        (2, 0, "start", None, None), (2, 1, "frame", True, None), (2, 1.9, "frame", True, None), (2, 1.9, "frame", True, None), (3, 0, "start", True, None), (4, 3, "frame", True, None), (None, 0, "start", True, None), (5, None, "start", True, None), (5, 1, None, None, None),
    ]
    events = spark.createDataFrame([(s, None if t is None else at(t), k, *rest) for k, (s, t, *rest) in enumerate(steps)], "session long, ts timestamp_ntz, event_id long, kind string, flag boolean, distance double").withColumn("phase", F.lit("other"))
    zero = telemetry.seconds("ts")
    base = events.where("event_id = 1").select(zero.alias("z")).first()["z"]
    found = [(r["session"], round(r["at"] - base, 3), r["phase"]) for r in telemetry.phase_timeline(events).orderBy("session", "at").collect()]
    one = [(0.0, "bootstrap"), (1.0, "refining"), (4.0, "ready"), (5.0, "refining"), (7.0, "travel"), (8.75, "refining"), (10.0, "ready")]
    assert found == [(1, *x) for x in one] + [(2, 0.0, "refining"), (3, 0.0, "bootstrap"), (3, 2.5, "refining")]
    assert telemetry.phase_timeline(events.limit(0)).count() == 0
