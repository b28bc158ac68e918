"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints by numpy exclusive-or and bit counts.

Distinct fingerprints are dealt to tiles of about ``TILE`` by the population counts of their four 16-bit quarters. Two
fingerprints at distance d differ by at most d in the sum of those counts' differences, so a pair of tiles whose boxes of
counts lie more than the radius apart is skipped without loss. A task compares one pair of tiles and emits a spanning forest
of the links it finds, never all pairs; components follow by star contraction over those edges.

The plan of tiles comes from a histogram over at most 17^4 quarter counts, so its size has a fixed bound.

Defined cases: null text, empty text or no word: fingerprint zero, linked like any other. A null id takes the component of
its fingerprint; the smallest id ignores nulls, so a component of null ids only has a null id. Repeated rows stay.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, join_counted, materialize, release

TILE, RADIUS, SHINGLE, SEED = 4096, 3, 3, 42
_PART = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
    ones = sum(np.unpackbits(hashes[i : i + _PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64) for i in range(0, len(hashes), _PART))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    found = pd.Series(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))
    release()
    return found


def fingerprints(column: str) -> Column:
    return F.pandas_udf(_fingerprints, "long")(column)


def _quarters():
    return [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))).alias(f"q{k}") for k in range(4)]


def plan_tiles(keys: np.ndarray, weights: np.ndarray, tile: int) -> list[np.ndarray]:
    """Splits the quarter-count keys at weighted medians until a leaf holds about ``tile`` fingerprints or a single key."""
    leaves, open_ = [], [np.arange(len(keys))] if len(keys) else []
    while open_:
        own = open_.pop()
        spread = keys[own].max(0) - keys[own].min(0)
        if weights[own].sum() <= tile or not spread.any():
            leaves.append(own)
            continue
        axis = int(spread.argmax())
        own = own[np.argsort(keys[own, axis], kind="stable")]
        value, total = keys[own, axis], np.cumsum(weights[own])
        at = np.flatnonzero(np.diff(value)) + 1  # splits between unequal counts only
        cut = at[np.abs(total[at - 1] - total[-1] / 2).argmin()]
        open_ += [own[:cut], own[cut:]]
    return leaves


def near_leaves(low: np.ndarray, high: np.ndarray, radius: int) -> pd.DataFrame:
    """Pairs of leaves whose boxes of population counts lie within the radius."""
    found = []
    for i in range(len(low)):
        gap = np.maximum(0, np.maximum(low[i] - high[i:], low[i:] - high[i])).sum(1)
        j = i + np.flatnonzero(gap <= radius)
        found.append(np.column_stack([np.full(len(j), i), j]))
    return pd.DataFrame(np.concatenate(found) if found else np.empty((0, 2), int), columns=["leaf_a", "leaf_b"]).astype("int32")


def spanning_links(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (as signed integers) that connect whatever fingerprints of ``a`` and ``b`` link; at most one for each of them."""
    a, b = np.sort(a.view(np.uint64)), np.sort(b.view(np.uint64))
    a, b = a[np.argsort(np.bitwise_count(a), kind="stable")], b[np.argsort(np.bitwise_count(b), kind="stable")]
    pop_a, pop_b = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    at_a, at_b, root, edges = place[: len(a)], place[len(a) :], np.arange(len(nodes)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(0, len(a), 64):
        rows = a[i : i + 64]
        left, right = np.searchsorted(pop_b, pop_a[i] - radius), np.searchsorted(pop_b, pop_a[min(i + 64, len(a)) - 1] + radius, "right")
        r, c = np.nonzero(np.bitwise_count(rows[:, None] ^ b[None, left:right]) <= radius)
        u, v = at_a[i + r], at_b[left + c]
        if len(u):
            while (flat := root[root])[...].tobytes() != root.tobytes():
                root[:] = flat
            apart = root[u] != root[v]
            for x, y in zip(u[apart].tolist(), v[apart].tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    edges.append((x, y))
    values = nodes.view(np.int64)
    return [(int(values[x]), int(values[y])) for x, y in edges]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) between the values of ``distinct.fp`` that connect exactly the pairs within the radius, transitively."""
    spark = distinct.sparkSession
    keyed = distinct.select("fp", *_quarters())
    seen = keyed.groupBy("q0", "q1", "q2", "q3").count().toPandas()  # at most 17^4 rows
    keys, weights = seen[["q0", "q1", "q2", "q3"]].to_numpy(np.int64), seen["count"].to_numpy(np.int64)
    leaves = plan_tiles(keys, weights, tile)
    parts = [max(1, -(-int(weights[x].sum()) // tile)) for x in leaves]
    of = [(*map(int, keys[k]), i, parts[i]) for i, own in enumerate(leaves) for k in own]
    leaf_of = spark.createDataFrame(of, "q0 int, q1 int, q2 int, q3 int, leaf int, parts int")
    low, high = (np.array([f(keys[x], axis=0) for x in leaves]).reshape(-1, 4) for f in (np.min, np.max))
    pairs = near_leaves(low, high, radius).assign(parts_a=lambda d: np.array(parts, "int32")[d.leaf_a], parts_b=lambda d: np.array(parts, "int32")[d.leaf_b])
    schema = "leaf_a int, leaf_b int, parts_a int, parts_b int"
    pairs = spark.createDataFrame(pairs.astype("int32"), schema) if len(pairs) else spark.createDataFrame([], schema)
    pairs = (
        pairs.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
        .where("leaf_a < leaf_b or part_a <= part_b")
    )
    tiles = materialize(
        keyed.join(F.broadcast(leaf_of), ["q0", "q1", "q2", "q3"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy("leaf", "part").agg(F.collect_list("fp").alias("fps")), "simhash-tiles",
    )
    side = lambda s: tiles.select(F.col("leaf").alias(f"leaf_{s}"), F.col("part").alias(f"part_{s}"), F.col("fps").alias(f"fps_{s}"))
    work = pairs.hint("shuffle_hash").join(side("a"), ["leaf_a", "part_a"]).join(side("b"), ["leaf_b", "part_b"])

    def compare(batches):
        for batch in batches:
            for a, b in zip(batch["fps_a"], batch["fps_b"], strict=True):
                if links := spanning_links(np.asarray(a, np.int64), np.asarray(b, np.int64), radius):
                    yield pd.DataFrame(links, columns=["u", "v"])

    size = max(12, len(leaves))
    dealt = work.repartition(size, F.xxhash64("leaf_a", "part_a", "leaf_b", "part_b"))  # the same at every attempt of a task
    return dealt.select("fps_a", "fps_b").mapInPandas(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``, root being the smallest node reachable: alternating star contraction.

    Each round is written to the shared folder; the rounds end when a round changes no edge, after about log of the longest path.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        after = materialize(small, "edges")
        mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = mark(after) == mark(now)
        discard(now)
        now = after
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp`` (signed), ``root`` (smallest fingerprint of the component), ``component_id`` for every document.

    Roots of frequent fingerprints, and ids of frequent roots, are broadcast, so however many copies a text has, they aren't one task's.
    """
    with bounded_batches(documents.sparkSession):
        own = materialize(documents.select("doc_id", fingerprints("text").alias("fp")), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    rooted = distinct.join(components(fingerprint_links(distinct, radius)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = join_counted(rooted.select("fp", "root", F.col("n").alias("rows")), least, ["root"], "n")
    return join_counted(own, named, ["fp"], "rows").select("doc_id", "fp", "root", "component_id")


def with_hex(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component: the one with the smallest id; columns stay, rows repeated under that id become one.

    If rows of one id lie in several components that have it as their smallest, one row of each stays. A component of null ids
    only keeps one row that has its smallest fingerprint.
    """
    found = materialize(simhash_components(documents.select("doc_id", "text"), radius), "components")
    own = "_" * (1 + max(map(len, documents.columns)))  # longer names than any of the table's
    kept, places, prints, group = (f"{own}_{n}" for n in ("kept", "places", "print", "group"))
    least = found.where("doc_id = component_id")
    chosen = materialize(least.groupBy(F.col("doc_id").alias(kept)).agg(F.count_distinct("root").alias(places)), "kept")
    match = F.col("doc_id") == F.col(kept)
    named = documents.join(chosen.where(F.col(places) == 1), match, "left_semi").dropDuplicates(["doc_id"])
    if not chosen.where(F.col(places) > 1).isEmpty():
        held = least.join(chosen.where(F.col(places) > 1), match).select(kept, F.col("fp").alias(prints), F.col("root").alias(group)).distinct()
        several = documents.join(held.select(kept).distinct(), match, "left_semi").withColumn(own, fingerprints("text"))
        several = several.join(held, match & (F.col(own) == F.col(prints))).dropDuplicates([kept, group])
        named = named.unionByName(several.select(*documents.columns))
    roots = found.where("component_id is null and fp = root").select(F.col("fp").alias("_root")).distinct()
    nameless = documents.where(F.col("doc_id").isNull()).withColumn("__fp", fingerprints("text"))
    nameless = nameless.join(roots, nameless["__fp"] == roots["_root"], "left_semi").dropDuplicates(["__fp"]).drop("__fp")
    return named.unionByName(nameless)
