"""Audits over bitmaps of ordinals: the counters that a pass over single points in Python gives, whatever the faults."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodforge.operators import audit, bitmaps

EXPECTED = "ordinal long, ix int, iy int, role string"
OWNED = f"{EXPECTED}, x double, y double"


def told(expected, owned):
    """Counters by cell, point by point."""
    want, got, lines = {o: (ix, iy, role) for o, ix, iy, role in expected}, defaultdict(list), {}
    for o, *rest in owned:
        got[o].append(rest)
    for o in want.keys() | got.keys():
        held = got.get(o, [])
        cell = want[o][:2] if o in want else min((r[0], r[1]) for r in held)
        line = lines.setdefault(cell, [0] * 6)
        line[0] += len(held) > 1
        line[1] += o in want and not held
        line[2] += o not in want
        line[3] += o in want and any((r[0], r[1]) != want[o][:2] for r in held)
        line[4] += o in want and any(r[2] != want[o][2] for r in held)
        line[5] += any(not (10 * r[0] <= r[3] <= 10 * r[0] + 10 and 10 * r[1] <= r[4] <= 10 * r[1] + 10) for r in held)
    return sorted((*cell, *line) for cell, line in lines.items())


@pytest.mark.parametrize("seed", range(4))
def test_audit_equals_a_pass_over_points(spark, seed):
    dice = random.Random(seed)
    start = dice.choice([-200, 0, 10**12])
    expected = [(start + k, dice.randrange(3), dice.randrange(2), dice.choice(["p001", "adaptive"])) for k in range(700)]
    expected += [(None, 0, 0, "p001")] if seed == 1 else []
    owned = []
    for o, ix, iy, role in expected:
        kind = dice.random()
        for _ in range(2 if kind < 0.01 else 0 if kind < 0.02 else 1):
            cell = (ix + (0.02 < kind < 0.03), iy)
            owned.append((o, int(cell[0]), cell[1], "p001" if 0.03 < kind < 0.04 else role, 10.0 * cell[0] + (50 if kind > 0.99 else 5), 10.0 * cell[1] + 5))
    owned += [(start + 5000 + k, 9, 9, "p001", 95.0, 95.0) for k in range(3)] + [(start + 63, 1, 1, "adaptive", 15.0, 15.0)]
    owned += [(None, 0, 0, "p001", 5.0, 5.0)] if seed in (1, 2) else []
    dice.shuffle(owned)
    e, o = spark.createDataFrame(expected, EXPECTED), spark.createDataFrame(owned, OWNED)
    assert sorted(map(tuple, audit.audit(e, o, 10.0, (0.0, 0.0)).collect())) == told(expected, owned)


def test_sound_parts_have_no_suspects(spark):
    e = spark.range(1000).select(F.col("id").alias("ordinal"), F.lit(0).alias("ix"), F.lit(0).alias("iy"), F.lit("p001").alias("role"))
    assert audit.suspects(e, e).count() == 0
    assert [r[0] for r in audit.suspects(e, e.where("ordinal <> 700")).collect()] == [700]
    words = bitmaps.words({"a": e, "b": e.limit(0)})
    assert words.count() == 16 and words.agg(F.sum(F.bit_count("a")), F.sum("a_n"), F.sum("b_n")).first()[:] == (1000, 1000, 0)


@pytest.mark.parametrize("seed", range(3))
def test_gaps_and_shared_keys(spark, seed):
    dice = random.Random(seed)
    draw = lambda: [dice.choice([None, *range(-70, 200)]) for _ in range(150)]
    left, right = draw(), draw()
    frames = [spark.createDataFrame([(k,) for k in side], "ordinal int") for side in (left, right)]
    keys = set(left) | set(right)
    gap = [sum(max(0, a.count(k) - b.count(k)) for k in keys) for a, b in ((left, right), (right, left))]
    assert list(audit.role_gap(*frames).first()) == gap
    assert audit.shared_keys(*frames).first()[0] == len(set(left) & set(right))
    assert audit.shared_keys(frames[0].limit(0), frames[1]).first()[0] == 0
