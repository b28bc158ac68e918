import math

import numpy as np
import pytest

from lodforge.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, n int, id long, links long, root long, least long"


def brute(rows):
    """(id, links, smallest reachable id, kept) of every row, sorted."""
    fit = lambda v, lab: lab is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    kept = [i for i, (_, v, lab) in enumerate(rows) if fit(v, lab)]
    partners = {i: [] for i in range(len(rows))}
    held = {i: np.array(rows[i][1], np.float32).astype(np.float64) for i in kept}
    for i in kept:
        for j in kept:
            if i != j and rows[i][2] == rows[j][2] and len(held[i]) == len(held[j]):
                if held[i] @ held[j] / (np.sqrt(held[i] @ held[i]) * np.sqrt(held[j] @ held[j])) >= 0.98:
                    partners[i].append(j)
    root = {}
    for i in partners:
        if i not in root:
            seen, open_ = {i}, [i]
            while open_:
                for j in partners[open_.pop()]:
                    if j not in seen:
                        seen.add(j)
                        open_.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            root |= dict.fromkeys(seen, min(ids, default=None))
    return sorted(((r[0], len(partners[i]), root[i], r[0] == root[i]) for i, r in enumerate(rows)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, 7, 7, 7) for r in rows], SCHEMA)


def got(spark, rows, **more):
    return sorted((tuple(r) for r in vectors.near_vectors(frame(spark, rows).repartition(4), **more).collect()), key=repr)


def noisy(random, centre, noise):
    return [float(x) for x in (centre + noise * np.linalg.norm(centre) / 4 * random.normal(0, 1, len(centre))).astype(np.float32)]


def made(random):
    centres = random.normal(0, 1, (12, 16))
    rows = [(k, noisy(random, centres[k % 12], 0.2 * random.random()), k % 3) for k in range(240)]
    rows += [(1000 + k, noisy(random, centres[0], 0.01), 1) for k in range(60)]  # near copies
    return rows + [(2000 + k, rows[5][1], rows[5][2]) for k in range(50)]  # exact copies


@pytest.mark.parametrize("tile", [7, 64, 2048])
def test_matches_brute_force(spark, tile):
    rows = made(np.random.default_rng(tile))
    assert got(spark, rows, tile=tile) == brute(rows)


def test_odd_rows(spark):
    random = np.random.default_rng(3)
    v = noisy(random, np.ones(16), 0.1)
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (2, v, None), (3, v, 2), (4, None, 1), (5, [], 1), (6, [0.0] * 16, 1), (7, [math.nan] + v[1:], 1), (8, [math.inf] + v[1:], 1), (9, [None, *v[1:]], 1)]
    rows += [(None, v, 1), (None, noisy(random, -np.ones(16), 0.1), 5), (10, [2 * x for x in v], 1), (11, v[:8], 1), (12, [1e-40] * 16, 3), (13, [3e38] * 16, 3), (14, [0.0, 1.0], 4), (15, [-0.0, 1.0], 4), (16, [-0.0, 0.0], 4)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_bounds_hold_and_only_doubtful_pairs_are_recomputed():
    random = np.random.default_rng(4)
    a, b = random.normal(0, 1, (600, 64)), random.normal(0, 1, (500, 64))
    b[:300] = a[:300] + random.normal(0, 0.2, (300, 64))
    b[:3], a[3] = a[:3] * 5, a[4]
    links, doubtful = set(), 0
    for r, c, n in vectors.cosine_links(a, b):
        links |= set(zip(r.tolist(), c.tolist(), strict=True))
        doubtful += n
    exact = vectors.unit(a) @ vectors.unit(b).T >= 0.98
    assert links == set(zip(*(x.tolist() for x in np.nonzero(exact)), strict=True)) and 0 < doubtful < 1000
    codes, scale, error, size = vectors.quantise(vectors.unit(a))
    assert np.allclose(np.linalg.norm(vectors.unit(a) - codes * scale[:, None], axis=1), error) and (error < 0.02).all() and (np.abs(codes) <= 127).all()


def test_a_chain_over_many_tiles_is_one_component(spark):
    step = math.acos(0.985)
    rows = [(k, [math.cos(k * step), math.sin(k * step), 0.0, 0.0], 0) for k in range(30)]
    assert got(spark, rows, tile=3) == brute(rows)


def test_far_tiles_are_skipped(spark):
    random = np.random.default_rng(6)
    centres = random.normal(0, 1, (8, 16))
    rows = [(k, 1, noisy(random, centres[k % 8], 0.01), 0) for k in range(400)]
    classes = spark.createDataFrame([(i, lab, v, 1) for i, _, v, lab in rows], "node long, label int, vector array<float>, n long").coalesce(1)
    tiles = vectors.cut_tiles(vectors.place(classes), 10).cache()
    number, pairs = tiles.count(), vectors.tile_pairs(tiles, 0.98).count()
    assert number >= 40 and number <= pairs < number * (number + 1) / 4
