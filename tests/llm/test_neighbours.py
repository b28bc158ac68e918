import numpy as np

from lodforge.llm import neighbours
from lodforge.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, top=5):
    sound = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    if not sound:
        return {}
    ids, x = np.array([i for i, _ in sound]), np.array([v for _, v in sound])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(x @ x.T, 12)
    out = {}
    for k, i in enumerate(ids):
        if i % 50 == 0:
            order = [j for j in np.lexsort((ids, -near[k])) if j != k][:top]
            out[i] = [(int(ids[j]), near[k, j]) for j in order]
    return out


def search(spark, rows):
    found = neighbours.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), neighbours.F.col("vec_id") % 50 == 0).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, small, "embeddings").collect()]
    found, expected = search(spark, rows), brute(rows)
    hit = [len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) / 5 for q in expected]
    assert np.mean(hit) >= 0.95
    for q in expected:
        known = dict(expected[q])
        assert all(abs(s - known[i]) < 1e-9 for i, s in found[q] if i in known)


def test_cases(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(i, one) for i in range(1, 40)] + [(0, one), (50, [0.0, 1.0, 0.0]), (100, None), (150, [0.0, 0.0, 0.0]), (200, [float("nan"), 1.0, 1.0]), (250, [None, 1.0, 1.0]), (300, [float("inf"), 1.0, 0.0]), (51, [0.5, 0.5, 0.0]), (52, [-1.0, 0.0, 0.0])]
    found = search(spark, rows)
    assert set(found) == {0, 50}
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5] and all(abs(s - 1) < 1e-12 for _, s in found[0])
    assert [i for i, _ in found[50]] == [51, 0, 1, 2, 3]
    assert search(spark, []) == {} and search(spark, [(0, one)]) == {}
    assert [i for i, _ in search(spark, [(0, one), (7, [0.0, 2.0, 0.0])])[0]] == [7]


def recall(found, expected):
    return np.mean([len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) / 5 for q in expected])


def test_near_copies(spark):
    source = np.random.default_rng(3)
    one = source.normal(size=64)
    one /= np.linalg.norm(one)
    x = np.concatenate([one + noise * source.normal(size=(1000, 64)) / 8 for noise in (0.01, 0.003)] + [source.normal(size=(500, 64))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    found, expected = search(spark, rows), brute(rows)
    assert all(len(found[q]) == 5 for q in expected)
    assert recall({q: v for q, v in found.items() if q < 2000}, {q: v for q, v in expected.items() if q < 2000}) >= 0.95


def test_nodes_apart_from_all_others(spark):
    source = np.random.default_rng(5)
    centres = source.normal(size=(4, 16))
    x = np.concatenate([np.repeat(centres, 600, axis=0) + 0.002 * source.normal(size=(2400, 16)), source.normal(size=(30, 16))])
    valid = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = neighbours.materialize(neighbours.build_nodes(neighbours.valid_vectors(valid)), "nodes")
    first = neighbours.materialize(neighbours._merged(neighbours.first_neighbours(nodes, 2430).where("src % 7 > 0 and src < 2400 and dst < 2400"), 20), "first")
    edges = neighbours._merged(neighbours.completed(first, nodes, 2430), 20).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T
    np.fill_diagonal(near, -9)
    for i in [*range(0, 2400, 7), *range(2400, 2430)]:
        assert set(edges["dst"][edges["src"] == i]) == set(np.argsort(-near[i])[:20])
    assert (edges.groupby("src").size() == 20).all() and len(edges) == 20 * 2430


def test_parts_differ_between_tables(spark):
    source = np.random.default_rng(6)
    x = np.concatenate([source.normal(size=16) + 1e-4 * source.normal(size=(2000, 16)) for _ in range(2)])
    valid = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = neighbours.materialize(neighbours.build_nodes(neighbours.valid_vectors(valid)), "nodes")
    met = {i: i for i in range(4000)}

    def top(i):
        while met[i] != i:
            met[i] = met[met[i]]
            i = met[i]
        return i

    for src, dst in neighbours.first_neighbours(nodes, 4000).select("src", "dst").distinct().toPandas().itertuples(index=False):
        met[top(src)] = top(dst)
    assert len({top(i) for i in range(4000)}) <= 2


def test_shuffled_rows_are_few_for_the_pairs_compared(spark):
    x = np.random.default_rng(8).normal(size=(4000, 16))
    vectors = neighbours.materialize(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vectors")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList()

    def stages():
        found = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = stages()
    found = neighbours.nearest(vectors, neighbours.F.col("vec_id") % 50 == 0).collect()
    assert len(found) == 400
    assert sum(n for k, n in stages().items() if k not in before) < 1_000_000


def test_rankings_of_keys_in_order():
    source = np.random.default_rng(9)
    for n in (0, 1, 3000):
        key, score = neighbours._once(neighbours._pairs(source.integers(0, 20, n), source.integers(0, 99, n)), source.integers(0, 9, n) / 9)
        order = np.lexsort((key, -score, key >> 32))
        own = key[order] >> 32
        assert list(neighbours._ranked(key, score, 7)) == list(order[np.arange(len(own)) - np.searchsorted(own, own) < 7])
        assert list(neighbours._distinct(key >> 32)) == sorted(set((key >> 32).tolist()))
