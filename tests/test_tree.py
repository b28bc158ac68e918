"""Hand cases of the tree, of hashing and of incremental counts."""

import pytest
from pyspark.sql import functions as F

from lodforge.functions.hashing import with_stable_hash
from lodforge.operators import pyramid, tree
from lodforge.operators.sampling import quota_allocation
from lodforge.operators.work import folder
from lodforge.streaming.census import incremental_counts


def splitmix(ordinal: int, salt: int) -> int:
    wrap = (1 << 64) - 1
    z = ((ordinal ^ salt) + 0x9E3779B97F4A7C15) & wrap
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & wrap
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & wrap
    return z ^ z >> 31


def points(spark, n: int):
    rows = spark.range(n).select(F.col("id").alias("ordinal"), (F.col("id") * 97 % 1000).cast("double").alias("x"), (F.col("id") * 53 % 1000).cast("double").alias("y"), F.lit(1.0).alias("z"))
    return with_stable_hash(rows.withColumns({"ix": F.lit(0), "iy": F.lit(0)}))


def test_hash_equals_integers(spark):
    salt = 0xFFFFFFFFFFFFFFFF
    found = with_stable_hash(spark.range(300).select((F.col("id") * 30_000_000_000_000_007).alias("ordinal")), salt).collect()
    assert all((r.hi << 32) + r.lo == splitmix(r.ordinal, salt) for r in found)


def test_points_are_owned_once(spark):
    owned = tree.residual_tree(points(spark, 900), tree.Profile(40, 100, 150, 4, 4), (0.0, 0.0)).collect()
    assert sorted(r.ordinal for r in owned) == list(range(900))
    assert sum(r.path == "" for r in owned) == 40 and {r.kind for r in owned} == {"internal", "leaf"}


def test_same_place_overflows_at_the_last_depth(spark):
    same = points(spark, 300).withColumns({"x": F.lit(5.0), "y": F.lit(5.0)})
    owned = tree.residual_tree(same, tree.Profile(10, 50, 60, 2, 4), (0.0, 0.0)).groupBy("path", "kind").count().collect()
    assert {tuple(r) for r in owned} == {("", "internal", 10), ("0", "internal", 10), ("00", "overflow", 280)}


def test_hashes_that_are_not_spread_evenly_are_still_ranked(spark):
    rows = spark.range(5000).select(F.col("id").alias("ordinal"), (F.col("id") % 3).cast("int").alias("node"), (F.col("id") % 2).cast("int").alias("cell"), ((1 << 32) - 1 - F.col("id") % 40).alias("hi"), (F.col("id") % 7).alias("lo"))
    quota = rows.groupBy("node", "cell").agg(F.count("*").alias("cnt")).withColumn("alloc", F.when(F.col("node") == 0, 0).when(F.col("cell") == 0, 25).otherwise(F.col("cnt")))
    got = {r["ordinal"] for r in tree.representatives(rows, quota, ("node",)).where("own").collect()}
    by = {}
    for r in rows.collect():
        by.setdefault((r.node, r.cell), []).append((r.hi, r.lo, r.ordinal))
    assert got == {o for (node, cell), held in by.items() if node for _, _, o in sorted(held)[: 25 if cell == 0 else None]}


def test_profiles_that_contradict_themselves(spark):
    sound = dict(target=400, leaf=1000, hard=1500, depth=5, grid=8, scale=2.0, least=100)
    odd = [dict(least=0), dict(least=400), dict(target=1000), dict(hard=900), dict(depth=0), dict(grid=0), dict(scale=0.0), dict(scale=float("nan")), dict(scale=float("inf")), dict(least=-1, scale=-2.0)]
    profiles = [sound, *[sound | o for o in odd]]
    assert tree.Profile(**sound).leaf == 1000
    table = spark.createDataFrame([(str(k), *[p[n] for n in ("least", "target", "leaf", "hard", "depth", "grid", "scale")]) for k, p in enumerate(profiles)], "id string, least int, target int, leaf int, hard int, depth int, grid int, scale double")
    told = {r["id"]: r["problem"] for r in pyramid.check_profiles(table).collect()}
    assert told == {str(k): "; ".join(tree.profile_problems(**p)) for k, p in enumerate(profiles) if k}
    for p in profiles[1:]:
        with pytest.raises(ValueError, match="must be"):
            tree.Profile(**p)
    with pytest.raises(ValueError, match="target is no whole number"):
        tree.Profile(target=True)
    assert pyramid.check_profiles(table.limit(0)).count() == 0


def test_no_points(spark):
    assert tree.residual_tree(points(spark, 0)).count() == 0


def test_files_are_counted_once(spark):
    base = folder(spark)
    put = lambda n: spark.range(n).select((F.col("id") % 2).alias("k")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    run = lambda: {tuple(r) for r in incremental_counts(spark.readStream.schema("k long").parquet(f"{base}/in"), ["k"], f"{base}/state").collect()}
    put(10)
    assert run() == {(0, 5), (1, 5)}
    assert run() == {(0, 5), (1, 5)}
    put(3)
    assert run() == {(0, 7), (1, 6)}


def test_levels_write_points_only_where_their_tables_are_too_many(spark, monkeypatch):
    places, write = [], tree.written
    monkeypatch.setattr(tree, "written", lambda df, name: (places.append(name), write(df, name))[1])
    run = lambda: sorted(tuple(r) for r in tree.residual_tree(points(spark, 900), tree.Profile(40, 100, 150, 2, 4), (0.0, 0.0)).collect())
    narrow = run()
    assert not [p for p in places if p.startswith("tree-")] and "owned" not in places and places.count("turned") == 1
    monkeypatch.setattr(tree, "FEW", 0)
    assert run() == narrow and "tree-0" in places


def test_spots_decide_as_levels_do(spark):
    """Uneven points, a grid that doesn't nest, hashes that aren't spread: against a level by level walk in plain Python."""
    rows = spark.range(3000).select(F.col("id").alias("ordinal"), (F.pmod(F.col("id") * 7919, F.lit(2000)) * F.when(F.col("id") % 3 == 0, 0.01).otherwise(1.0)).alias("x"), (F.pmod(F.col("id") * 104729, F.lit(1999)) + 0.5).alias("y"), F.lit(1.0).alias("z"))
    rows = with_stable_hash(rows.withColumns({"ix": F.lit(0), "iy": F.lit(0)})).withColumn("hi", F.when(F.col("ordinal") % 2 == 0, (1 << 32) - 1 - F.col("ordinal") % 40).otherwise(F.col("hi")))
    p = tree.Profile(40, 100, 150, 3, 5)
    got = {r["ordinal"]: (r["path"], r["kind"], r["input"]) for r in tree.residual_tree(rows, p, (0.0, 0.0)).collect()}
    want = {}

    def walk(held, path, low, size):
        inner = len(held) > p.leaf and len(path) < p.depth
        if not inner:
            kind = "leaf" if len(held) <= p.leaf else "max-depth-leaf" if len(held) <= p.hard else "overflow"
            want.update({r["ordinal"]: (path, kind, len(held)) for r in held})
            return
        at = lambda v, o: min(max(int((v - o) / size * p.grid), 0), p.grid - 1)
        cells = {}
        for r in held:
            cells.setdefault(at(r["y"], low[1]) * p.grid + at(r["x"], low[0]), []).append(r)
        counts = spark.createDataFrame([(0, k, len(v)) for k, v in cells.items()], "node int, cell int, cnt long")
        quota = {q["cell"]: q["alloc"] for q in quota_allocation(counts, p.target).collect()}
        rest = []
        for k, v in cells.items():
            v.sort(key=lambda r: (r["hi"], r["lo"], r["ordinal"]))
            want.update({r["ordinal"]: (path, "internal", len(held)) for r in v[: quota[k]]})
            rest += v[quota[k] :]
        half = size / 2
        for d in range(4):
            e, n = d % 2, d // 2
            below = [r for r in rest if (r["x"] >= low[0] + half) == e and (r["y"] >= low[1] + half) == n]
            if below:
                walk(below, f"{path}{d}", (low[0] + e * half, low[1] + n * half), half)

    walk(rows.collect(), "", (0.0, 0.0), 2000.0)
    assert got == want and {k for _, k, _ in want.values()} >= {"internal", "leaf"}


def test_points_are_shuffled_for_no_level(spark):
    """The plan that reads the points joins them once, with the table of spots."""
    plan = tree.residual_tree(points(spark, 900), tree.Profile(40, 100, 150, 4, 4), (0.0, 0.0))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Relation") == 2
