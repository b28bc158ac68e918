import re
from collections import Counter

import numpy as np
import xxhash

from lodforge.llm import simhash
from lodforge.llm.common import table

from . import cases


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    bits = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_matches_brute_force(spark, small):
    documents = table(spark, small, "documents").limit(150)
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    prints = {i: brute_print(t) for i, t in rows.items()}
    chosen = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = simhash.with_hex(simhash.simhash_components(chosen)).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(prints)


def test_small_tiles_lose_no_link(spark):
    random = np.random.default_rng(3)
    base = random.integers(0, 2**64, 60, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ (np.uint64(1) << random.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << random.integers(0, 64, 60, dtype=np.uint64)) for _ in range(8)])
    values = np.unique(np.append(near, [np.uint64(0), np.uint64(1), np.uint64(2**64 - 1)]))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.fingerprint_links(frame, tile=20)).collect()}
    expected = brute_components({int(v): int(v) for v in values})
    groups = lambda d: {frozenset(k for k in d if d[k] == r) for r in set(d.values())}
    ours = {int(v): found.get(int(v.astype(np.int64)), int(v.astype(np.int64))) for v in values}
    assert groups(ours) == groups(expected)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(found.get(i, 0) == 0 for i in range(201)) and found[501] == 500 and 500 not in found


def test_cases(spark):
    found = simhash.simhash_components(cases.frame(spark)).collect()
    assert len(found) == len(cases.rows())
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by[0]["component_id"] == by[1]["component_id"] == by[2]["component_id"] == 0 and by[0]["fp"] == 0
    assert by[5]["component_id"] == 4 and by[100]["component_id"] == 6
    assert simhash.simhash_components(cases.frame(spark, [])).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_one(cases.frame(spark)).collect()]
    assert len(kept) == len(set(kept)) and {0, 4, 6} <= set(kept) and not {1, 2, 5, 100} & set(kept) and None in kept
    assert simhash.keep_one(cases.frame(spark)).columns == cases.frame(spark).columns


def test_hot_copies_and_ids_in_several_components(spark):
    texts = ["one two three four five six", "seven eight nine ten eleven", None]
    rows = [(k, texts[0]) for k in range(400)] + [(k, None) for k in range(1000, 1300)] + [(-1, texts[0]), (-1, texts[1]), (-1, texts[1]), (7, texts[1]), (5000, "alone it stands here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(frame).collect()]
    prints = {k: brute_print(t) for k, (_, t) in enumerate(rows)}
    group, least = brute_components(prints), {}
    for k, (i, _) in enumerate(rows):
        least[group[k]] = min(i, least.get(group[k], i))
    assert sorted(found) == sorted((i, least[group[k]]) for k, (i, _) in enumerate(rows))
    kept = sorted((r["doc_id"], r["text"] or "") for r in simhash.keep_one(frame).collect())
    assert kept == [(-1, texts[0]), (-1, texts[1]), (1000, ""), (5000, "alone it stands here")]
