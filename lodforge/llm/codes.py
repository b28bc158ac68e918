"""Vector code compression: integer product codes whose codebooks come from dual-tree Lloyd rounds.

Every vector becomes integers floor(256 * x), cut into equal consecutive parts; each part position has a codebook of its own.
A round is one pass over the vectors. Inside a batch, one tree is built over its parts and one over the codebook's entries, and
both are descended together: a pair of nodes whose least distance exceeds the greatest distance of another entry node to the same
part node is dropped, a part node left with one entry is assigned as a whole by its cached sum and count, and leaves still
uncertain compare integers. All of it is exact: bounds are integers and only strictly worse nodes go, so ties stay until the
lower index wins. A task hands on one sum and count for each component of each entry, Spark adds those up, and the driver holds
codebooks only (entries * dimensions numbers).

Defined cases: vectors that are null, empty or hold null or non-finite components are dropped, as are those whose length is
no multiple of the number of parts or differs from that of the kept vector with the smallest id. Null ids come after all others
where first entries are chosen; equal ids are ordered by vector. Fewer vectors than entries make fewer entries. Components
are held to +-2^27, so that every distance of up to 64 dimensions fits a 64-bit integer; a sum over labels that doesn't is null. An empty
table gives no rows, and its codebooks are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize

PARTS, ENTRIES, ROUNDS, SCALE, LIMIT, LEAF = 16, 64, 2, 256.0, 1 << 27, 4


def to_integers(vectors: pa.Array, dims: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).clip(-LIMIT, LIMIT).astype(np.int64).reshape(-1, dims)


class Tree:
    """A balanced tree over integer points: a level's nodes are equal slices of one order, halved at the median of the widest axis.

    ``lo``, ``hi``, ``sums``, ``counts`` are lists by level. Slots that pad the points to whole leaves copy a point and count nothing;
    a node of such slots only has count zero.
    """

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        depth = max(0, int(np.ceil(np.log2(len(points) / leaf))))
        size = -(-len(points) // (1 << depth)) << depth
        self.order = np.concatenate([np.arange(len(points)), np.zeros(size - len(points), np.int64)])
        self.real = np.arange(size) < len(points)
        self.depth = depth
        for level in range(depth):
            own = points[self.order].reshape(1 << level, -1, points.shape[1])
            axis = (own.max(1) - own.min(1)).argmax(1)
            value = np.take_along_axis(own, axis[:, None, None], 2)[:, :, 0]
            value = np.where(self.real.reshape(value.shape), value, np.iinfo(np.int64).max)  # padding last, so that it fills whole nodes
            sort = (value.argsort(1, kind="stable") + np.arange(1 << level)[:, None] * own.shape[1]).ravel()
            self.order, self.real = self.order[sort], self.real[sort]
        self.points = points[self.order]
        held = np.where(self.real[:, None], self.points, 0)
        self.lo, self.hi, self.sums, self.counts = [], [], [], []
        for level in range(depth + 1):
            cut = lambda a: a.reshape(1 << level, -1, *a.shape[1:])  # noqa: B023, E731
            self.lo.append(cut(self.points).min(1))
            self.hi.append(cut(self.points).max(1))
            self.sums.append(cut(held).sum(1))
            self.counts.append(cut(self.real).sum(1))


def _bounds(a: Tree, level_a: int, node_a: np.ndarray, b: Tree, level_b: int, node_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between the boxes of paired nodes."""
    lo_a, hi_a, lo_b, hi_b = a.lo[level_a][node_a], a.hi[level_a][node_a], b.lo[level_b][node_b], b.hi[level_b][node_b]
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    far = np.maximum(hi_a - lo_b, hi_b - lo_a)
    return (gap * gap).sum(1), (far * far).sum(1)


def _prune(tree: Tree, level: int, node: np.ndarray, entries: Tree, at: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (sorted by part node) without those that another entry node of the same part node beats everywhere."""
    least, most = _bounds(tree, level, node, entries, at, entry)
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    best = np.repeat(np.minimum.reduceat(most, starts), np.diff(np.r_[starts, len(node)]))
    return node[least <= best], entry[least <= best]


def dual_assign(points: np.ndarray, codebook: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of each point (ties to the lower index), each entry's sum and count, and the number of points assigned by whole nodes."""
    tree, entries = Tree(points, leaf), Tree(codebook, 1)
    width, k = 1 << tree.depth, len(codebook)
    chosen = np.empty(len(tree.points), np.int64)
    sums, counts, whole = np.zeros_like(codebook), np.zeros(k, np.int64), 0
    node, entry, level, at = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while len(node):
        if at < entries.depth:
            at, node = at + 1, np.repeat(node, 2)
            entry = (2 * entry[:, None] + [0, 1]).ravel()
            real = entries.counts[at][entry] > 0
            node, entry = _prune(tree, level, node[real], entries, at, entry[real])
        if at == entries.depth:
            alone = np.r_[True, node[1:] != node[:-1]] & np.r_[node[1:] != node[:-1], True]
            n, e = node[alone], entries.order[entry[alone]]
            np.add.at(sums, e, tree.sums[level][n])
            np.add.at(counts, e, tree.counts[level][n])
            whole += int(tree.counts[level][n].sum())
            chosen.reshape(1 << level, -1)[n] = e[:, None]
            node, entry = node[~alone], entry[~alone]
            if level == tree.depth:
                break
        if level < tree.depth and len(node):
            level += 1
            kept = [node * 2, node * 2 + 1]
            node, entry = np.concatenate(kept), np.concatenate([entry, entry])
            sort = np.argsort(node, kind="stable")
            node, entry = _prune(tree, level, node[sort], entries, at, entry[sort])
    if len(node):
        index = entries.order[entry]
        sort = np.lexsort((index, node))
        node, index = node[sort], index[sort]
        rows = tree.points.reshape(width, -1, points.shape[1])
        gap = rows[node] - codebook[index][:, None, :]
        distance = (gap * gap).sum(2)
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        best = np.minimum.reduceat(distance, starts)
        tied = np.where(distance == np.repeat(best, np.diff(np.r_[starts, len(node)]), 0), index[:, None], k)
        nearest = np.minimum.reduceat(tied, starts)
        chosen.reshape(width, -1)[node[starts]] = nearest
        real = tree.real.reshape(width, -1)[node[starts]]
        np.add.at(sums, nearest[real], rows[node[starts]][real])
        np.add.at(counts, nearest[real], 1)
    out = np.empty(len(points), np.int64)
    out[tree.order[tree.real]] = chosen[tree.real]
    return out, sums, counts, whole


def usable(vectors: DataFrame, id: str, vector: str, label: str, parts: int) -> DataFrame:
    """``id``, ``label``, ``vector`` of the vectors that take part, under those names."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite
    return vectors.where(fit).select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors with the smallest ids, at most ``entries`` rows read by the driver."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()["vector"]
    if not len(first):
        return np.zeros((parts, 0, 1), np.int64)
    dims = len(first[0])
    first = [v for v in first.to_pylist() if len(v) == dims]
    ints = to_integers(pa.array(first, pa.list_(pa.float64())), dims)
    return ints.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()


def _parted(batch: pa.RecordBatch, codebooks: np.ndarray) -> np.ndarray:
    parts, _, width = codebooks.shape
    column = batch.column("vector")
    return to_integers(column, parts * width).reshape(-1, parts, width)


def lloyd_round(kept: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floors of mean components; an entry without parts stays."""
    parts, entries, width = codebooks.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(codebooks), np.zeros((parts, entries), np.int64)
        for batch in batches:
            ints = _parted(batch, codebooks)
            for part in range(parts if len(ints) else 0):
                _, s, c, _ = dual_assign(ints[:, part], codebooks[part])
                sums[part] += s
                counts[part] += c
        cell = np.flatnonzero(np.repeat(counts.ravel() > 0, width))
        if len(cell):
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums.ravel()[cell]), pa.array(np.repeat(counts.ravel(), width)[cell])], ["cell", "total", "n"])

    told = kept.select("vector").mapInArrow(totals, "cell long, total long, n long")
    summed = told.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    after = codebooks.copy()
    for row in summed.collect():  # at most entries * dimensions rows
        after.ravel()[row["cell"]] = int(row["total"]) // row["n"]
    return after


def train_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    codebooks = first_codebooks(kept, parts, entries)
    for _ in range(rounds if codebooks.shape[1] else 0):
        codebooks = lloyd_round(_same_length(kept, codebooks), codebooks)
    return codebooks


def _same_length(kept: DataFrame, codebooks: np.ndarray) -> DataFrame:
    return kept.where(F.size("vector") == codebooks.shape[0] * codebooks.shape[2])


def encode(kept: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``id``, ``label``, ``code`` (binary, one byte a part), ``error`` (squared distances summed over parts)."""
    parts, entries, _ = codebooks.shape
    if entries > 256:
        raise ValueError("a code has one byte a part: at most 256 entries")
    own = _same_length(kept, codebooks) if entries else kept.limit(0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = _parted(batch, codebooks)
            codes = np.stack([dual_assign(ints[:, part], codebooks[part])[0] for part in range(parts)], axis=1)
            gap = ints - codebooks[np.arange(parts), codes]
            code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), code, pa.array((gap * gap).sum((1, 2)))], ["id", "label", "code", "error"])

    types = dict(kept.dtypes)
    return own.mapInArrow(assign, f"id {types['id']}, label {types['label']}, code binary, error long")


def decode(coded: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``coded`` with ``vector``: the entries that the code names, as floats."""
    table = (codebooks + 0.5) / SCALE

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([np.frombuffer(c, np.uint8) for c in batch.column("code").to_pylist()], np.int64).reshape(-1, len(codebooks))
            vectors = pa.array(list(table[np.arange(len(codebooks)), codes].reshape(len(codes), -1).astype(np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*batch.schema.names, "vector"])

    return coded.mapInArrow(rebuild, ", ".join(f"`{n}` {t}" for n, t in coded.dtypes) + ", vector array<float>")


def codebooks_sha256(codebooks: np.ndarray) -> str:
    """Of all entries' components as decimal integers by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``id``, ``label``, ``code``, ``error``, ``label_error`` of every vector that takes part, and the codebooks.

    ``label_error`` adds up the errors of equal labels, nulls together; frequent labels reach the rows by broadcast (at most 1,000 of
    them), the others by a shuffle.
    """
    kept = usable(vectors, id, vector, label, PARTS)
    codebooks = train_codebooks(kept)
    coded = materialize(encode(kept, codebooks), "codes")
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("n"))
    return join_counted(coded, sums, ["label"], "n"), codebooks
