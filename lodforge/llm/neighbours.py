"""Approximate nearest neighbours: an NN-descent graph built by Spark shuffles, searched greedily.

Equal vectors form one node. Random-projection blocks of bounded size give each node first neighbours; nodes that get fewer than
``DEGREE`` are compared with all nodes. Rounds follow until fewer than ``CHANGED`` of the edges are new: a round brings
every node's neighbours, and nodes that have it as a neighbour, together at that node, compares them with each other and
keeps each node's nearest ``DEGREE``: neighbours of neighbours. A query starts at its own node and expands the nearest nodes
not yet expanded, all of its pool in a turn; the pool doubles from turn to turn until two turns running leave the query's
nearest unchanged. Those nearest and all that tie with them give the result.

Nodes are numbered and dealt to buckets. What a round or turn moves are messages between buckets, a row for each pair of them with
columns as bytes (``_exchange``), so Spark shuffles few rows and a task compares its bucket's pairs in numpy.

Vectors travel as they are stored and every comparison is in double precision, so the order holds within groups of near copies
too; edges keep the cosine less one, which single precision holds to seven digits however small. A node's list in a round is bounded by ``DEGREE`` and ``REVERSE``, a block by ``BLOCK``, a bucket by ``BUCKET`` nodes on average. The README states measured recall.

Defined cases: null vectors, zero vectors, those with null or non-finite components or with another length than the smallest
valid id's take no part, as queries or candidates; with at most five candidates all are returned; queries sharing a vector share the search.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, release

DEGREE, REVERSE, TABLES, BLOCK, CHANGED, BEST = 20, 12, 6, 2048, 0.01, 6
POOL, FILL, TOP, BUCKET, SAMPLE, SEED = 256, 3, 5, 4096, 2048, 11
#: Nodes expanded at once in a task.
PART = 100_000
#: Scores nearer to each other than this may be equal but for rounding.
TIE = 1e-12
_EDGE = "src long, dst long, score float"
#: What buckets write to one another: columns of a kind of mail, each as bytes.
_MAIL = "b int, kind string, parts array<binary>"
_GRAPH, _POOL = ("<i4", "<i4", "<f4", "i1"), ("<i4", "<i4", "<f8", "i1", "<i4", "<i4", "u1")
_LOW = (1 << 32) - 1


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``e`` (array of float where the table has that, else of double) of the rows that take part."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("e"))
    limit = float("inf")
    sound = F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("e", lambda x: x != 0)
    rows = rows.where(sound)
    length = rows.agg(F.min_by(F.size("e"), "vec_id")).first()[0]
    return rows.where(F.size("e") == F.lit(length or 0))


def build_nodes(valid: DataFrame, top: int = TOP) -> DataFrame:
    """``node`` (smallest id), ``e``, ``members`` (the ``top`` + 1 smallest ids), ``v`` (bytes of ``e``)."""
    first = valid.withColumn("_r", F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))).where(F.col("_r") <= top + 1)
    grouped = first.groupBy("e").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_set("vec_id")).alias("members"))

    kind = _kind(grouped)

    def raw(column: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(r, kind).tobytes() for r in column], dtype=object)

    return grouped.select("node", "e", "members", F.pandas_udf(raw, "binary")("e").alias("v"))


def _kind(nodes: DataFrame) -> str:
    return "<f4" if nodes.schema["e"].dataType.simpleString() == "array<float>" else "<f8"


def _matrix(raw, kind: str) -> np.ndarray:
    raw = list(raw)
    return _unit(_rows(np.frombuffer(b"".join(raw), np.uint8), len(raw)), kind)


def _unit(raw: np.ndarray, kind: str) -> np.ndarray:
    """Unit vectors in double precision, of bytes in rows."""
    x = np.ascontiguousarray(raw).view(kind).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def first_neighbours(nodes: DataFrame, count: int, degree: int = DEGREE) -> DataFrame:
    """Edges to the nearest nodes of each node's blocks. Planes and their medians come from at most ``SAMPLE`` nodes."""
    kind = _kind(nodes)
    some = _matrix((r["v"] for r in nodes.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()), kind)
    bits = max(0, math.ceil(math.log2(max(count, 1) / (BLOCK * 0.6))))
    tables = TABLES if bits else 1  # one block holds all
    planes = np.random.default_rng(SEED).normal(size=(some.shape[1], tables * bits))
    middle = np.median(some @ planes, axis=0)

    def codes(raw: pd.Series) -> pd.Series:
        sides = (_matrix(raw, kind) @ planes > middle).reshape(len(raw), tables, bits).astype(np.int64)
        return pd.Series(list((sides << np.arange(bits)).sum(2)))

    dealt = nodes.select("node", "v", F.posexplode(F.pandas_udf(codes, "array<long>")("v")).alias("t", "code"))
    full = dealt.groupBy("t", "code").count().where(F.col("count") > BLOCK).select("t", "code", F.ceil(F.col("count") / BLOCK).alias("parts"))
    placed = dealt.join(full, ["t", "code"], "left").withColumn("part", F.pmod(F.xxhash64("node", "t"), F.coalesce("parts", F.lit(1))))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        ids, x = block["node"].to_numpy(), _matrix(block["v"], kind)
        k = min(degree, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"src": ids[:0], "dst": ids[:0], "score": x[:0, 0]})
        to, score = [], []
        for begin in range(0, len(ids), 512):
            near = x[begin : begin + 512] @ x.T - 1
            near[np.arange(len(near)), begin + np.arange(len(near))] = -9
            at = np.argpartition(-near, k - 1, axis=1)[:, :k]
            to.append(ids[at].ravel()), score.append(np.take_along_axis(near, at, 1).ravel())
        return pd.DataFrame({"src": np.repeat(ids, k), "dst": np.concatenate(to), "score": np.concatenate(score)})

    return placed.repartition(_tasks(nodes.sparkSession, tables * count), "t", "code", "part").groupBy("t", "code", "part").applyInPandas(compare, _EDGE)


def _tasks(spark, rows: int) -> int:
    """Tasks for rows that are much work each, so that their bytes alone would make too few."""
    return max(1, min(4 * spark.sparkContext.defaultParallelism, rows // 512), rows // 32768)


def _distinct(x: np.ndarray) -> np.ndarray:
    """In order, each value once; by sorting, which is many times faster here than numpy's hashes."""
    x = np.sort(x)
    return x[np.diff(x, prepend=x[:1] - 1) != 0]


def _ranked(key: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best scores of each node, which is the upper half of a key; keys come in order, and ties go to the smaller."""
    group = np.cumsum(np.diff(key >> 32, prepend=key[:1] >> 32) != 0)
    order = np.argsort(-score, kind="stable")
    order = order[np.argsort(_short(group[order]), kind="stable")]
    own = group[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < most]


def _short(x: np.ndarray) -> np.ndarray:
    """Numbers in 16 bits if they fit, which are sorted digit by digit."""
    return x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def _once(key: np.ndarray, *columns: np.ndarray) -> tuple:
    """Keys in order, each with the values of its first place."""
    key, at = np.unique(key, return_index=True)
    return key, *(c[at] for c in columns)


def _merged(edges: DataFrame, degree: int, buckets: int = 8) -> DataFrame:
    """Each node's ``degree`` nearest edges; rows of a bucket of nodes are compared in one task."""

    def run(batches):
        batches = list(batches)
        if batches:
            src, dst, score = (np.concatenate([batch[c].to_numpy() for batch in batches]) for c in ("src", "dst", "score"))
            batches.clear()
            (src_ids, own), (dst_ids, other) = (np.unique(x, return_inverse=True) for x in (src, dst))
            best = np.argsort(-score, kind="stable")
            key, score = _once(_pairs(own, other)[best], score[best])
            kept = _ranked(key, score, degree)
            yield pd.DataFrame({"src": src_ids[key[kept] >> 32], "dst": dst_ids[key[kept] & _LOW], "score": score[kept]})
        release()

    return edges.select("src", "dst", "score").repartition(buckets, "src").mapInPandas(run, _EDGE)


def completed(edges: DataFrame, nodes: DataFrame, count: int, degree: int = DEGREE) -> DataFrame:
    """``edges``, and for nodes that have fewer than ``degree`` of them those to their nearest of all nodes, both ways.

    Such nodes lie apart from all others in every table; each is compared with every node, in blocks.
    """
    if count < 2:
        return edges
    full = edges.groupBy("src").count().where(F.col("count") >= min(degree, count - 1)).select(F.col("src").alias("node"))
    apart = materialize(nodes.select("node", "v").join(full, "node", "left_anti"), "apart")
    n = apart.count()
    if not n:
        return edges
    kind, across, down = _kind(nodes), math.ceil(n / 1024), math.ceil(count / 4096)
    dealt = lambda rows, own, other, k, m: rows.select("node", "v", F.pmod(F.xxhash64("node"), F.lit(k)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))

    def compare(few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"src": [], "dst": [], "score": []}).astype({"src": "int64", "dst": "int64", "score": "float32"})]
        if len(few) and len(many):
            a, b = few["node"].to_numpy(), many["node"].to_numpy()
            near = _matrix(few["v"], kind) @ _matrix(many["v"], kind).T - 1
            near[a[:, None] == b] = -9
            for src, dst, score in ((a, b, near), (b, a, near.T)):
                k = min(degree, len(dst))
                at = np.argpartition(-score, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(score, at, 1).ravel()
                out.append(pd.DataFrame({"src": np.repeat(src, k), "dst": dst[at].ravel(), "score": best.astype(np.float32)})[best > -9])
        return pd.concat(out, ignore_index=True)

    further = dealt(apart, "a", "b", across, down).groupBy("a", "b").cogroup(dealt(nodes.select("node", "v"), "b", "a", down, across).groupBy("a", "b"))
    return edges.union(further.applyInPandas(compare, _EDGE))


def _post(kind: str, to: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """Mail of ``columns`` (a value a row) to each of the buckets in ``to``."""
    order = np.argsort(_short(to), kind="stable")
    to, columns = to[order], [c[order] for c in columns]
    ends = [*np.flatnonzero(np.diff(to)) + 1, len(to)] if len(to) else []
    starts = [0, *ends[:-1]] if ends else []
    return _frame(to[starts] if ends else to, kind, [[c[k:end].tobytes() for c in columns] for k, end in zip(starts, ends, strict=True)])


def _frame(to: np.ndarray, kind: str, parts: list[list[bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"b": np.asarray(to, np.int32), "kind": pd.Series([kind] * len(parts), dtype=object), "parts": pd.Series(parts, dtype=object)})


def _read(mail: dict, kind: str, *types: str) -> list[np.ndarray]:
    """The columns of all mail of a kind in a bucket, one after the other; the mail is given up."""
    parts = mail.pop(kind, [])
    raw = [b"".join(p[k] for p in parts) for k in range(len(types))]
    del parts
    return [np.frombuffer(x, t) if x else np.empty(0, t) for x, t in zip(raw, types, strict=True)]


def _rows(raw: np.ndarray, count: int) -> np.ndarray:
    """Bytes as a row for each of ``count`` vectors."""
    return raw.reshape(count, len(raw) // max(count, 1))


def _exchange(mail: DataFrame, buckets: int, take, schema: str = _MAIL) -> DataFrame:
    """Brings each bucket's mail together in a task of its own, where ``take(b, mail by kind)`` gives further frames."""

    def run(batches):
        boxes = {}
        for batch in batches:
            for b, kind, parts in zip(batch["b"], batch["kind"], batch["parts"], strict=True):
                boxes.setdefault(b, {}).setdefault(kind, []).append(parts)
            del batch
        for b in sorted(boxes):
            yield from take(b, boxes.pop(b))
        release()

    return mail.repartitionById(buckets, "b").mapInPandas(run, schema)


def _each(mail: DataFrame, take) -> DataFrame:
    """Further mail from every row of ``mail`` as it lies."""

    def run(batches):
        for batch in batches:
            for b, kind, parts in zip(batch["b"], batch["kind"], batch["parts"], strict=True):
                yield from take(b, {kind: [parts]})

    return mail.mapInPandas(run, _MAIL)


def buckets_of(spark, count: int) -> int:
    """Buckets of up to ``BUCKET`` nodes, smaller ones where there are fewer nodes than cores could take."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, -(-count // min(BUCKET, max(BUCKET // 4, count // (3 * cores)))))


def numbered(nodes: DataFrame, buckets: int) -> DataFrame:
    """``nodes`` with a ``number`` each: its place in its bucket times ``buckets``, and the bucket. It tells where a node's vector lies."""
    dealt = nodes.withColumn("_b", F.pmod(F.xxhash64("node"), F.lit(buckets)))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("node")) - 1
    return dealt.withColumn("number", place.cast("long") * buckets + F.col("_b")).drop("_b")


def held_vectors(nodes: DataFrame, buckets: int) -> DataFrame:
    """One row of mail to each bucket: the vectors of its nodes, in the order of their numbers."""

    def deal(batches):
        for batch in batches:
            at = batch["number"].to_numpy()
            yield _post("dealt", at % buckets, at, _rows(np.frombuffer(b"".join(batch["v"]), np.uint8), len(at)))

    def gather(b, mail):
        at, raw = _read(mail, "dealt", "<i8", "u1")
        yield _frame([b], "vectors", [[np.sort(at).astype("<i4").tobytes(), _rows(raw, len(at))[np.argsort(at)].tobytes()]])

    return _exchange(nodes.select("number", "v").mapInPandas(deal, _MAIL), buckets, gather)


def _own(mail: dict) -> np.ndarray:
    """The bytes of a bucket's vectors, a row each: that of a number lies at the number over ``buckets``."""
    at, raw = _read(mail, "vectors", "<i4", "u1")
    return _rows(raw, len(at))


def _neighbourhood(mail: dict, reverse: int) -> tuple[np.ndarray, np.ndarray]:
    """``at``, ``member``, by ``at``: a node's neighbours and the ``reverse`` nearest of the nodes it is a neighbour of."""
    src, dst, _, _ = _read(mail, "graph", *_GRAPH)
    at, member, score = _read(mail, "back", "<i4", "<i4", "<f4")
    back, score = _once(_pairs(at, member), score)
    key = _distinct(np.concatenate([_pairs(src, dst), back[_ranked(back, score, reverse)]]))
    return key >> 32, key & _LOW


def _backward(graph: DataFrame, buckets: int) -> DataFrame:
    """``graph`` and its edges as mail to the nodes they lead to."""

    def turn(_, mail):
        src, dst, score, _new = _read(mail, "graph", *_GRAPH)
        yield _post("back", dst % buckets, dst, src, score)

    return graph.union(_each(graph, turn))


def packed(edges: DataFrame, buckets: int) -> DataFrame:
    """Flat edges between numbers as one row of mail a bucket."""

    def run(batches):
        for batch in batches:
            src, dst = batch["src"].to_numpy(), batch["dst"].to_numpy()
            yield _post("flat", src % buckets, src.astype("<i4"), dst.astype("<i4"), batch["score"].to_numpy().astype("<f4"))

    def gather(b, mail):
        src, dst, score = _read(mail, "flat", "<i4", "<i4", "<f4")
        yield _post("graph", np.full(len(src), b), src, dst, score, np.ones(len(src), np.int8))

    return _exchange(edges.select("src", "dst", "score").mapInPandas(run, _MAIL), buckets, gather)


def descend(graph: DataFrame, held: DataFrame, buckets: int, kind: str, degree: int = DEGREE) -> DataFrame:
    """One round: ``graph`` with the edges between neighbours of a node that beat a member's farthest neighbour.

    Buckets write to one another: the farthest edges and vectors of a node go once to every bucket that has it as a neighbour.
    """

    def ask(b, mail):
        at, member = _neighbourhood(mail, REVERSE)
        yield _post("met", np.full(len(at), b), at.astype("<i4"), member.astype("<i4"))
        wanted = _distinct(member)
        yield _post("wanted", wanted % buckets, wanted.astype("<i4"), np.full(len(wanted), b, "<i4"))

    def answer(b, mail):
        src, _, score, _ = _read(mail, "graph", *_GRAPH)
        wanted, asker = _read(mail, "wanted", "<i4", "<i4")
        raw = _own(mail)
        place, n = src // buckets, len(raw)
        farthest = np.full(n, 9, np.float32)
        np.minimum.at(farthest, place, score)
        least = np.where(np.bincount(place, minlength=n) >= degree, farthest, np.float32(-3))
        for k in _distinct(asker):
            part = wanted[asker == k]
            yield _post("vectors", np.full(len(part), k), part, least[part // buckets].astype("<f4"), raw[part // buckets])
        for parts in mail.get("met", []):
            yield _frame([b], "met", [parts])

    def meet(_, mail):
        at, member = _read(mail, "met", "<i4", "<i4")
        if not len(at):
            return
        ids, least, raw = _read(mail, "vectors", "<i4", "<f4", "u1")
        order = np.argsort(ids)
        ids, least, unit = ids[order], least[order], _unit(_rows(raw, len(ids)), kind)[order]
        _, first, size = np.unique(at, return_index=True, return_counts=True)
        local = np.searchsorted(ids, member)
        column, found = np.arange(size.max()), []
        for k in range(0, len(first), 256):
            inside = column < size[k : k + 256, None]
            one = local[np.where(inside, first[k : k + 256, None] + column, first[k : k + 256, None])]
            x = unit[one]
            near = x @ x.transpose(0, 2, 1) - 1
            near[~(inside[:, :, None] & inside[:, None, :])] = -9
            near[:, column, column] = -9
            best = min(BEST, len(column))
            to = np.argpartition(-near, best - 1, axis=2)[:, :, :best]
            s = np.take_along_axis(near, to, 2)
            g, r, c = np.nonzero((s > least[one][:, :, None]) & (s > -9))
            found.append((_pairs(ids[one[g, r]], ids[one[g, to[g, r, c]]]), s[g, r, c].astype(np.float32)))
        key, score = _once(*(np.concatenate(f) for f in zip(*found, strict=True)))
        kept = _ranked(key, score, degree)
        src, dst = key[kept] >> 32, key[kept] & _LOW
        yield _post("found", src % buckets, src.astype("<i4"), dst.astype("<i4"), score[kept])

    def keep(b, mail):
        src, dst, score, _ = _read(mail, "graph", *_GRAPH)
        more, to, further = _read(mail, "found", "<i4", "<i4", "<f4")
        both = np.concatenate([_pairs(src, dst), _pairs(more, to)])
        key, score, new = _once(both, np.concatenate([score, further]), (np.arange(len(both)) >= len(src)).astype(np.int8))
        kept = _ranked(key, score, degree)
        src, dst = key[kept] >> 32, key[kept] & _LOW
        yield _post("graph", np.full(len(src), b), src.astype("<i4"), dst.astype("<i4"), score[kept], new[kept])

    asked = _exchange(_backward(graph, buckets), buckets, ask)
    answered = _exchange(asked.union(graph).union(held), buckets, answer)
    return _exchange(_exchange(answered, buckets, meet).union(graph), buckets, keep)


def _new_edges(graph: DataFrame) -> tuple[int, int]:
    """Edges of a graph, and how many of them its round brought."""

    def run(batches):
        for batch in batches:
            new = [np.frombuffer(p[3], np.int8) for p in batch["parts"]]
            yield pd.DataFrame({"n": [len(x) for x in new], "new": [int(x.sum()) for x in new]})

    told = graph.mapInPandas(run, "n long, new long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("new"), F.lit(0))).first()
    return told[0], told[1]


def neighbour_graph(nodes: DataFrame, held: DataFrame, count: int, buckets: int, changed: float = CHANGED, degree: int = DEGREE) -> DataFrame:
    """Edges to the nearest nodes found, as mail to the buckets of their nodes, once a round brings fewer than ``changed`` of them."""
    first = materialize(_merged(first_neighbours(nodes, count, degree), degree, buckets), "first")
    graph = materialize(packed(_merged(completed(first, nodes, count, degree), degree, buckets), buckets), "graph")
    discard(first)
    while True:
        after = materialize(descend(graph, held, buckets, _kind(nodes), degree), "graph")
        every, fresh = _new_edges(after)
        discard(graph)
        graph = after
        if fresh <= changed * every:
            return graph


def _place(number: np.ndarray, buckets: int) -> np.ndarray:
    """Places of nodes in their buckets, in two bytes instead of a number's four: buckets hold ``BUCKET`` nodes on average."""
    place = number // buckets
    if len(place) and place.max() >= 1 << 16:
        raise ValueError("a bucket holds over 65,536 nodes")
    return place.astype("<u2")


def _slices(asked: np.ndarray, pairs: int) -> list[tuple[int, int]]:
    """Ranges of queries (in order) that take a few million of ``pairs`` each, so that a task never compares all at once."""
    count = min(len(asked), 1 + pairs // (40 * PART))
    ends = [len(asked) * k // count for k in range(count + 1)]
    return [(asked[low], asked[high - 1]) for low, high in zip(ends, ends[1:], strict=False)]


def search(seeds: DataFrame, held: DataFrame, graph: DataFrame, buckets: int, kind: str, pool: int = POOL, top: int = TOP) -> DataFrame:
    """``q``, ``number``, ``score``: for each node ``q`` of ``seeds`` (numbers) itself, the ``top`` nearest that greedy search reaches, and what ties with them.

    A turn expands all of a query's pool at once. Its first ``FILL`` turns fill the pool; each later one keeps twice as many
    nodes as the one before, and a query ends with the second turn in a row that changes none of its ``top`` nearest, or that leaves nothing to expand.
    A query's pool lies in the bucket of its node. In a turn it writes to the buckets of the nodes to expand, these to the buckets
    of their neighbours, which send the scores back.
    """

    def link(b, mail):
        at, member = _neighbourhood(mail, DEGREE)
        yield _post("around", np.full(len(at), b), at.astype("<i4"), member.astype("<i4"))

    def start(b, mail):
        (q,) = _read(mail, "seeds", "<i4")
        q = _distinct(q)
        if len(q):
            columns = q, q, np.full(len(q), 2.0), np.zeros(len(q), np.int8), np.zeros(len(q), "<i4"), q, _own(mail)[q // buckets]
            yield _frame([b], "pool", [[c.tobytes() for c in columns]])

    def deal(batches):
        for batch in batches:
            q = batch["q"].to_numpy()
            yield _post("seeds", q % buckets, q.astype("<i4"))

    around = materialize(_exchange(_backward(graph, buckets), buckets, link), "around")
    now = materialize(_exchange(seeds.select("q").mapInPandas(deal, _MAIL).union(held), buckets, start), "pool")

    def expand(_, mail):
        q, node, _, done, *_ = _read(mail, "pool", *_POOL)
        open_ = done == 0
        yield _post("expand", node[open_] % buckets, q[open_], node[open_])

    def tell(_, mail):
        """A query's vector, for all buckets."""
        *_, q, raw = _read(mail, "pool", *_POOL)
        yield _frame(range(buckets), "asked", [[q.tobytes(), raw.tobytes()]] * buckets)

    def reach(_, mail):
        q, node = _read(mail, "expand", "<i4", "<i4")
        at, member = _read(mail, "around", "<i4", "<i4")
        order = np.argsort(q, kind="stable")
        q, node = q[order], node[order]
        begin, end = np.searchsorted(at, node), np.searchsorted(at, node, "right")
        for k in range(0, len(q), PART):  # a part's queries are whole but for its ends, so few of its candidates come again
            size = (end - begin)[k : k + PART]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[k : k + PART], size)
            key = _distinct(_pairs(np.repeat(q[k : k + PART], size), member[place]))
            yield _post("reached", (key & _LOW) % buckets, (key >> 32).astype("<i4"), _place(key & _LOW, buckets))

    def measure(b, mail):
        q, place = _read(mail, "reached", "<i4", "<u2")
        if not len(q):
            return
        x = _unit(_own(mail), kind)
        asked, raw = _read(mail, "asked", "<i4", "u1")
        order = np.argsort(asked)
        asked, questions = asked[order], _unit(_rows(raw, len(asked)), kind)[order]
        for low, high in _slices(asked, len(q)):
            inside = (q >= low) & (q <= high)
            key = _distinct(_pairs(q[inside], place[inside]))
            own, other = key >> 32, key & _LOW
            one, first = np.unique(own, return_index=True)
            score = np.empty(len(own))
            for at, begin, end in zip(np.searchsorted(asked, one), first, [*first[1:], len(own)], strict=True):
                score[begin:end] = x[other[begin:end]] @ questions[at]
            yield _post(f"scores {b}", own % buckets, own.astype("<i4"), other.astype("<u2"), score)

    def best(size: int, turn: int):
        def run(b, mail):
            q, node, score, _, since, asked, raw = _read(mail, "pool", *_POOL)
            raw = _rows(raw, len(asked))
            told = [(int(name.split()[1]), *_read(mail, name, "<i4", "<u2", "<f8")) for name in sorted(mail) if name.startswith("scores")]
            more, further = (np.concatenate([np.empty(0, t), *(x[k] for x in told)]) for k, t in ((1, "<i4"), (3, "<f8")))
            to = np.concatenate([np.empty(0, "<i4"), *(place.astype("<i4") * buckets + at for at, _, place, _ in told)])
            del told
            for low, high in _slices(np.sort(asked), len(more)):
                held, come, own = ((x >= low) & (x <= high) for x in (q, more, asked))
                yield from settle(b, (q[held], node[held], score[held], since[held]), (more[come], to[come], further[come]), asked[own], raw[own])

        def settle(b, held, come, asked, raw):
            (q, node, score, since), (more, to, further) = held, come
            key, score, old, since = _once(np.concatenate([_pairs(q, node), _pairs(more, to)]), np.concatenate([score, further]), np.arange(len(q) + len(more)) < len(q), np.concatenate([since, np.full(len(more), turn, "<i4")]))
            kept = _ranked(key, score, size)
            key, score, old, since = key[kept], score[kept], old[kept], since[kept]
            q, node = key >> 32, key & _LOW
            one, first, n = np.unique(q, return_index=True, return_counts=True)
            place = np.arange(len(q)) - np.repeat(first, n)
            newest = np.maximum.reduceat(np.where(place <= top, since, 0), first)
            ended = np.logical_and.reduceat(old, first) | ((newest < turn - 1) & (turn > FILL + 1))
            least = np.where(n > top, score[first + np.minimum(top, n - 1)], -3.0)
            over = np.repeat(ended, n)
            out = over & (score >= np.repeat(least, n) - TIE)
            yield _post("ended", np.full(out.sum(), b), q[out].astype("<i4"), node[out].astype("<i4"), score[out])
            if not over.all():
                live, left = np.isin(asked, one[~ended]), ~over
                columns = q[left].astype("<i4"), node[left].astype("<i4"), score[left], old[left].astype(np.int8), since[left], asked[live], raw[live]
                yield _frame([b], "pool", [[c.tobytes() for c in columns]])

        return run

    turn, size, ended = 0, pool, []
    while not now.isEmpty():
        turn += 1
        if turn >= FILL:
            size *= 2
        reached = _exchange(_each(now, expand).union(around), buckets, reach)
        scores = _exchange(reached.union(_each(now, tell)).union(held), buckets, measure)
        after = materialize(_exchange(scores.union(now), buckets, best(size, turn)), "pool")
        ended.append(after.where("kind = 'ended'"))
        now = after.where("kind = 'pool'")

    def flat(batches):
        for batch in batches:
            for parts in batch["parts"]:
                q, node, score = (np.frombuffer(p, t) for p, t in zip(parts, ("<i4", "<i4", "<f8"), strict=True))
                yield pd.DataFrame({"q": q.astype(np.int64), "number": node.astype(np.int64), "score": score})

    found = "q long, number long, score double"
    return reduce(DataFrame.union, ended).mapInPandas(flat, found) if ended else now.mapInPandas(flat, found)


def nearest(vectors: DataFrame, is_query, top: int = TOP, pool: int = POOL) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query row's nearest other rows by cosine in double precision."""
    valid = materialize(valid_vectors(vectors), "valid")
    nodes = materialize(build_nodes(valid, top), "nodes")
    count = nodes.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    buckets = buckets_of(vectors.sparkSession, count)
    nodes = materialize(numbered(nodes, buckets), "numbered")
    held = materialize(held_vectors(nodes, buckets), "held")
    graph = neighbour_graph(nodes.drop("node").withColumnRenamed("number", "node"), held, count, buckets)
    asking = materialize(valid.where(is_query).join(nodes.select("e", F.col("number").alias("q")), "e").select(F.col("vec_id").alias("query_id"), "q"), "asking")
    near = search(asking.select("q").distinct(), held, graph, buckets, _kind(nodes), pool, top).select("q", "number")

    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        def parts(x):
            x = np.array(x.tolist(), np.float64)
            big = np.abs(x).max(1, keepdims=True)
            scale = np.where((big > 1e150) | (big < 1e-150), big, 1.0)  # no overflow in squares
            return x / scale

        x, y = parts(a), parts(b)
        return pd.Series((x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))))

    pairs = near.join(nodes.select("number", "members", F.col("e").alias("e_node")), "number").join(nodes.select(F.col("number").alias("q"), F.col("e").alias("e_q")), "q")
    exact = pairs.select("q", "members", F.pandas_udf(cosine, "double")("e_q", "e_node").alias("score"))
    rows = asking.join(exact, "q").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
