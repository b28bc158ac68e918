import math

import numpy as np
import pytest

from lodforge.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, id int, code string, n long, __n int"


def brute(points, codebook):
    return ((points[:, None] - codebook[None]) ** 2).sum(2).argmin(1)


@pytest.mark.parametrize(("n", "k", "width", "spread"), [(1, 1, 4, 5), (7, 3, 1, 2), (100, 64, 4, 40), (1000, 64, 4, 3), (5000, 64, 4, 200), (333, 5, 2, 1), (64, 64, 3, 0)])
def test_dual_trees_assign_as_brute_force(n, k, width, spread):
    random = np.random.default_rng(n)
    points, codebook = random.integers(-spread, spread + 1, (n, width)), random.integers(-spread, spread + 1, (k, width))
    chosen, sums, counts, _ = codes.dual_assign(points, codebook)
    expected = brute(points, codebook)
    own = np.zeros_like(codebook)
    np.add.at(own, expected, points)
    assert (chosen == expected).all() and (sums == own).all() and (counts == np.bincount(expected, minlength=k)).all()


def test_tight_clusters_are_assigned_by_whole_nodes():
    random = np.random.default_rng(1)
    centres = random.integers(-5000, 5000, (64, 4))
    points = np.repeat(centres, 100, 0) + random.integers(-3, 4, (6400, 4))
    chosen, _, _, whole = codes.dual_assign(points, centres)
    assert (chosen == brute(points, centres)).all() and whole > 3000


def lloyd(rows):
    """Codes, errors and codebooks by plain loops over Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v and len(v) % 16 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 16
    kept = [r for r in kept if len(r[1]) == 16 * width]
    ints = [[max(-(1 << 27), min(1 << 27, math.floor(256 * float(np.float32(x))))) for x in v] for _, v, _ in kept]
    parts = [[v[p * width : p * width + width] for p in range(16)] for v in ints]
    books = [[v[p] for v in parts[:64]] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            groups = {}
            for v in parts:
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    found = [[near(v[p], books[p]) for p in range(16)] for v in parts]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        labels[lab] = labels.get(lab, 0) + e
    return sorted((str(i), bytes(k for _, k in f), e, labels[lab]) for (i, _, lab), f, e in zip(kept, found, errors, strict=True)), books


def rows():
    random = np.random.default_rng(5)
    vector = lambda: [float(x) for x in random.normal(0, 0.4, 32).astype(np.float32)]
    out = [(int(i), vector(), int(i) % 3 if i % 7 else None) for i in random.permutation(150)]
    out += [out[3], out[3], (out[5][0], vector(), 1)]  # repeated rows, an id with two vectors
    out += [(200, None, 1), (201, [], 1), (202, [math.nan] * 32, 1), (203, [math.inf] + [0.0] * 31, 1), (204, [None] + [1.0] * 31, None), (205, [1.0] * 17, 1), (206, [1.0] * 48, 1)]
    return out + [(None, vector(), 2), (207, [0.0] * 32, None), (208, [-0.0] * 32, None), (209, [3e38] + [0.5] * 31, 9), (210, [-3e38] + [0.5] * 31, 9)]


def frame(spark, some):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in some], SCHEMA)


def test_matches_plain_lloyd_with_odd_rows(spark):
    expected, books = lloyd(rows())
    found, codebooks = codes.compress(frame(spark, rows()).repartition(5))
    assert codebooks.transpose(0, 1, 2).tolist() == books
    assert sorted((str(r["id"]), bytes(r["code"]), r["error"], r["label_error"]) for r in found.collect()) == expected


def test_fewer_vectors_than_entries_and_none(spark):
    few = rows()[:5]
    expected, books = lloyd(few)
    found, codebooks = codes.compress(frame(spark, few))
    assert codebooks.tolist() == books and sorted((str(r["id"]), bytes(r["code"]), r["error"], r["label_error"]) for r in found.collect()) == expected
    assert all(r["error"] == 0 for r in found.collect())
    nothing, empty = codes.compress(frame(spark, []))
    assert nothing.count() == 0 and codes.codebooks_sha256(empty) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_decoded_vectors_are_near(spark):
    random = np.random.default_rng(2)
    base = random.normal(0, 1, (40, 32)).astype(np.float32)
    some = [(i, [float(x) for x in base[i % 40]], 0) for i in range(80)]
    found, codebooks = codes.compress(frame(spark, some))
    back = {r["id"]: r["vector"] for r in codes.decode(found, codebooks).collect()}
    assert len(back) == 80 and all(np.abs(np.array(back[i]) - base[i % 40]).max() < 0.01 for i in back)
