from collections import defaultdict

from lodforge.llm import mixing
from lodforge.llm.common import table

from . import cases


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {s: 0.0 for s in order}, [s for s in order if sizes[s]], 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def check(found, near):
    sizes, target, taken, largest = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for r in found:
        sizes[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    expected = brute_targets(dict(sizes))
    for s in sizes:
        assert abs(target[s] - expected[s]) < 1e-6 * max(1, expected[s])
        assert abs(taken[s] - target[s]) <= near * largest[s] + 1e-6


def mixed(documents):
    return mixing.mix(mixing.measured(documents)).withColumn("taken", mixing.F.col("size") * mixing.F.col("times"))


def test_targets_and_nearness(spark, small):
    documents = table(spark, small, "documents")
    found = mixed(documents).collect()
    check(found, 1)
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in documents.collect()}
    assert {r["doc_id"]: r["size"] for r in found} == words
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixed(documents.repartition(7)).collect()), key=str)


def test_very_uneven_sources(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "big", None) for i in range(300)] + [(1000 + i, "w", "en", f"s{i}", None) for i in range(5)] + [(2000, "w " * 900, "en", None, None), (2001, "", "en", "void", None)]
    check(mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect(), 1)


def test_cases(spark):
    found = mixing.mixed_sizes(cases.frame(spark)).collect()
    assert len(found) == len(cases.rows())
    assert mixing.mixed_sizes(cases.frame(spark, [])).count() == 0
    out = mixing.mixed_documents(cases.frame(spark))
    assert out.columns == cases.frame(spark).columns
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == sum(r["taken"] for r in found)
    assert mixing.mixed_documents(cases.frame(spark, [])).count() == 0
