"""Embedding near-duplicates: int8 tile products with an error bound for each vector; doubtful pairs alone are recomputed in double precision.

A unit vector u is held as s * q with q in int8, and its error e = |u - s * q| is measured, not estimated. For two vectors the true cosine
lies within e_a * |s_b q_b| + e_b * |s_a q_a| + e_a * e_b of the product of their codes (Cauchy-Schwarz), so a pair whose product
is below the threshold by more than that can't be a link, and one above it by more than that is one. Only pairs between are recomputed.

Equal vectors of a label are compared once, with their number as weight. The distinct vectors of a label are sorted along a curve
through their first principal axes and cut into tiles of at most ``TILE``; a task compares one pair of tiles. Unit vectors with
cosine t lie at most sqrt(2 - 2t) apart, so a pair of tiles whose boxes along the axes lie further apart is skipped without loss.
A task hands on its vectors' counts of links and a spanning forest of the links, never all pairs.
The axes come from a sample of at most ``SAMPLE`` vectors and decide only which tiles are skipped, not what is found.

Comparison within a label is quadratic in its distinct vectors, less the tiles skipped: that is the method's limit.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing.
Vectors of different lengths don't link. A repeated row counts as another vector. The smallest id ignores nulls; a row whose component has
null ids only is kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize
from .simhash import components

THRESHOLD, TILE, SAMPLE, AXES, STEPS, SLACK = 0.98, 2048, 2048, 4, 16, 1e-9
#: Most pairs of rows whose products a task holds at once.
_ROWS = 256
#: Tiles of a label are dealt to so many groups for pairing, so that a label's pairs don't meet in one task.
_GROUPS = 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows over their length in double precision; scaled first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, measured error |u - s q| and length |s q| of each row."""
    scale = np.abs(units).max(1) / 127.0
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    held = codes * scale[:, None]
    rest = units - held
    return codes, scale, np.sqrt((rest * rest).sum(1)), np.sqrt((held * held).sum(1))


def cosine_links(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Linked (row of a, row of b), block by block, and how many pairs of the block were recomputed."""
    a, b = unit(a), unit(b)
    code_a, scale_a, error_a, size_a = quantise(a)
    code_b, scale_b, error_b, size_b = quantise(b)
    wide = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of products are exact integers in either
    held = code_b.astype(wide).T
    for i in range(0, len(a), _ROWS):
        rows = slice(i, i + _ROWS)
        near = (code_a[rows].astype(wide) @ held) * scale_a[rows, None] * scale_b
        bound = error_a[rows, None] * size_b + (size_a[rows] + error_a[rows])[:, None] * error_b + SLACK
        linked = near - bound >= threshold
        r, c = np.nonzero((near + bound >= threshold) & ~linked)
        for k in range(0, len(r), 1 << 15):  # few vectors at a time in double precision
            x, y = r[k : k + (1 << 15)], c[k : k + (1 << 15)]
            linked[x, y] = np.einsum("ij,ij->i", a[rows][x], b[y]) >= threshold
        found_r, found_c = np.nonzero(linked)
        yield i + found_r, found_c, len(r)


def compare_tiles(nodes_a: np.ndarray, a: np.ndarray, weight_a: np.ndarray, nodes_b: np.ndarray, b: np.ndarray, weight_b: np.ndarray, threshold: float = THRESHOLD):
    """((node, weight of its linked vectors), (node, node)): counts of linked nodes, and edges that connect them all."""
    same = nodes_a[0] == nodes_b[0]
    shift = 0 if same else len(nodes_a)
    nodes = nodes_a if same else np.concatenate([nodes_a, nodes_b])
    links, root, edges = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), []
    for r, c, _ in cosine_links(a, b, threshold):
        if same:
            r, c = r[r != c], c[r != c]
        np.add.at(links, r, weight_b[c])
        if not same:
            np.add.at(links, shift + c, weight_a[r])
        c = c + shift
        apart = root[r] != root[c]
        r, c = r[apart], c[apart]
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else []
        for x, others in zip(r[starts].tolist() if len(r) else [], np.split(c, starts[1:]) if len(r) else [], strict=True):
            groups, first = np.unique(root[others], return_index=True)
            new = groups != root[x]
            if new.any():
                edges += [(x, y) for y in others[first[new]].tolist()]
                joined = np.append(groups[new], root[x])
                root[np.isin(root, joined)] = joined.min()
    some = np.flatnonzero(links)
    return (nodes[some], links[some]), [(int(nodes[x]), int(nodes[y])) for x, y in edges]


def principal_axes(classes: DataFrame, dims_most: int = 4096) -> dict[int, np.ndarray]:
    """For each vector length in a bounded sample, up to ``AXES`` orthonormal directions of greatest spread."""
    sample = classes.where(F.size("vector") <= dims_most).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").toArrow()["vector"].to_pylist()
    axes = {}
    for length in {len(v) for v in sample}:
        units = unit(np.array([v for v in sample if len(v) == length], np.float64))
        values, directions = np.linalg.eigh((units - units.mean(0)).T @ (units - units.mean(0)))
        axes[length] = np.ascontiguousarray(directions[:, ::-1][:, : min(AXES, length)])
    return axes


def curve_keys(places: np.ndarray) -> np.ndarray:
    """Interleaved bits of the places along the axes, each cut into ``STEPS`` between -1 and 1 with finer steps in the middle."""
    step = np.clip((np.tanh(3 * places) / 2 + 0.5) * STEPS, 0, STEPS - 1).astype(np.int64)
    key = np.zeros(len(places), np.int64)
    for bit in reversed(range(STEPS.bit_length() - 1)):
        for axis in range(places.shape[1]):
            key = key << 1 | (step[:, axis] >> bit & 1)
    return key


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def place(classes: DataFrame) -> DataFrame:
    """``classes`` with ``length``, ``places`` (along its axes) and ``curve``, the key that tiles are cut by."""
    axes = principal_axes(classes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("vector").offsets.to_numpy())
            for length in np.unique(lengths):
                own = batch.filter(pa.array(lengths == length))
                units = unit(_matrix(own.column("vector"), length))
                places = units @ axes[length] if length in axes else np.zeros((len(units), 1))
                arrays = [*own.columns, pa.array(np.full(len(units), length, np.int32)), pa.array(list(places), pa.list_(pa.float64())), pa.array(curve_keys(places))]
                yield pa.RecordBatch.from_arrays(arrays, [*own.schema.names, "length", "places", "curve"])

    return classes.mapInArrow(placed, ", ".join(f"{n} {t}" for n, t in classes.dtypes) + ", length int, places array<double>, curve long")


def cut_tiles(placed: DataFrame, tile: int = TILE) -> DataFrame:
    """One row a tile: ``label``, ``length``, ``tile`` (unique), its box (``lo``, ``hi``), ``nodes``, ``weights``, and its vectors flat.

    Rows are dealt by ranges of (label, length, curve), so a frequent label is many tasks' work and a tile is a run of neighbours.
    """
    kind, inner = dict(placed.dtypes)["label"], dict(placed.dtypes)["vector"]
    flat = pa.float64() if "double" in inner else pa.float32()

    def flush(key: tuple, number: int, part: list) -> pa.RecordBatch:
        column = lambda name: pa.concat_arrays([p.column(name) for p in part])
        places = np.array(column("places").to_pylist())
        fields = [
            [key[0]], [key[1]], [(TaskContext.get().partitionId() << 32) + number], [places.min(0) - SLACK], [places.max(0) + SLACK], [column("node").to_numpy()], [column("n").to_numpy()],
            [column("vector").flatten().to_numpy(zero_copy_only=False).astype(flat.to_pandas_dtype())],
        ]
        types = [part[0].schema.field("label").type, pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 2, *[pa.list_(pa.int64())] * 2, pa.list_(flat)]
        return pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, types, strict=True)], ["label", "length", "tile", "lo", "hi", "nodes", "weights", "flat"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, now, number = [], 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, lengths = batch.column("label").to_pylist(), batch.column("length").to_pylist()
            cuts = [i for i in range(1, len(labels)) if labels[i] != labels[i - 1] or lengths[i] != lengths[i - 1]]
            for start, end in zip([0, *cuts], [*cuts, len(labels)], strict=True):
                key = (labels[start], lengths[start])
                if held and key != now:
                    yield flush(now, number, part)
                    part, held, number = [], 0, number + 1
                now = key
                while start < end:
                    take = min(end - start, tile - held)
                    part.append(batch.slice(start, take))
                    held, start = held + take, start + take
                    if held == tile:
                        yield flush(now, number, part)
                        part, held, number = [], 0, number + 1
        if held:
            yield flush(now, number, part)

    dealt = placed.repartitionByRange("label", "length", "curve").sortWithinPartitions("label", "length", "curve", "node")
    return dealt.mapInArrow(tiles, f"label {kind}, length int, tile long, lo array<double>, hi array<double>, nodes array<long>, weights array<long>, flat {inner}")


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """``a``, ``b``: tiles of equal label and length whose boxes come as near as linked vectors can be."""
    reach = 2 - 2 * threshold + SLACK
    narrow = tiles.select("label", "length", "tile", "lo", "hi")
    group = F.pmod(F.xxhash64("tile"), F.lit(_GROUPS))
    a = narrow.select("label", "length", group.alias("g"), F.col("tile").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    b = narrow.select("label", "length", F.explode(F.array(*[F.lit(k).cast("long") for k in range(_GROUPS)])).alias("g"), F.col("tile").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    gaps = F.zip_with(F.arrays_zip("lo_a", "hi_a"), F.arrays_zip("lo_b", "hi_b"), lambda x, y: F.greatest(F.lit(0.0), x["lo_a"] - y["hi_b"], y["lo_b"] - x["hi_a"]))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    return a.join(b, ["label", "length", "g"]).where((F.col("a") <= F.col("b")) & (apart <= reach)).select("a", "b")


def vector_links(classes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """From ``classes`` (node, label, vector, n): rows ``u``, ``v``, ``links``. Where v is null, links is a part of u's number of linked
    vectors outside its class; else (u, v) is one of the edges that connect exactly the linked nodes, transitively."""
    tiles = materialize(cut_tiles(place(classes), tile), "tiles")
    side = lambda s: tiles.select(F.col("tile").alias(s), F.col("length").alias(f"length_{s}"), F.col("nodes").alias(f"nodes_{s}"), F.col("weights").alias(f"weights_{s}"), F.col("flat").alias(f"flat_{s}"))
    pairs = materialize(tile_pairs(tiles, threshold), "pairs")
    dealt = pairs.repartition(F.xxhash64("a", "b"))
    work = dealt.hint("shuffle_hash").join(side("a"), "a").join(side("b").drop("length_b"), "b").select("length_a", *[f"{c}_{s}" for s in "ab" for c in ("nodes", "weights", "flat")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                take = lambda name, kind: np.asarray(batch.column(name)[i].values.to_numpy(zero_copy_only=False), kind)  # noqa: B023, E731
                length = batch.column("length_a")[i].as_py()
                sides = [x for s in "ab" for x in (take(f"nodes_{s}", np.int64), take(f"flat_{s}", np.float64).reshape(-1, length), take(f"weights_{s}", np.int64))]
                (nodes, links), edges = compare_tiles(*sides, threshold=threshold)
                u, v = (np.array(edges, np.int64).T if edges else np.empty((2, 0), np.int64))
                none = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(p) for p in ([pa.array(nodes), pa.array(u)], [none(len(nodes)), pa.array(v)], [pa.array(links), none(len(u))])], ["u", "v", "links"])

    return work.mapInArrow(compare, "u long, v long, links long")


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``id``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id reachable), ``kept``: one row a vector."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    fit = F.coalesce(F.col(label).isNotNull() & F.col(vector).isNotNull() & sound, F.lit(False))
    plain = F.transform(vector, lambda x: x + F.lit(0).cast("float"))  # one zero, not two
    own = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), plain.alias("vector"), fit.alias("fit"))
    rows = own.where("fit").select("id", "label", "vector")
    grouped = rows.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    told = materialize(vector_links(classes.select("node", "label", "vector", "n"), threshold, tile), "links")
    counts = told.where("v is null").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "node")
    roots = components(told.where("v is not null").select("u", "v"))
    marks = [F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2")]
    named = classes.select("node", "label", *marks, "least", "n").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "named")
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    facts = join_counted(named, whole, ["root"], "members").select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", "n")
    linked = join_counted(rows.select("id", "label", *marks), facts, ["label", "k1", "k2"], "n").select("id", "n_links", "component_id")
    alone = own.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
