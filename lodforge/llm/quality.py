"""Quality rules: an isolation forest over rule statistics, with its cut-off calibrated from labelled rows.

Every document gets counts of a few plain rules. Random axis-parallel splits are grown over the statistics of documents that
are labelled good; a document that few splits isolate is anomalous. The forest and the cut-off are fitted on a bounded,
hash-ordered set of labelled rows (``Fit.rows``); counting and scoring cover every document.

Defined cases: a null text counts as empty; a document with no word fails the base rules; a null ``quality`` takes no part in
the fit; without labelled good rows the method keeps what the base rules keep; repeated rows each get their own result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_SPACES = SPACE.encode()
_UPPER = bytes(range(65, 91))
_MARKS = b"!?"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    fresh = count()
    ids = np.fromiter((seen[w] if w in seen else seen.setdefault(w, next(fresh)) for w in words), np.int64, n)
    rolled = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - width + 1 + k].astype(np.uint64)
    ordered = np.sort(rolled)
    if not (ordered[1:] == ordered[:-1]).any():  # equal windows have equal sums, so none repeats
        return 0
    code, span = ids, 1
    while span < width:  # exact window identity, by doubling
        code = np.unique(code[:-span] * (n + 1) + code[span:], return_inverse=True)[1]
        span *= 2
    starts = np.flatnonzero(np.bincount(code)[code] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def rule_counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one whole text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    return (len(words), len(text) - less(_SPACES), less(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), less(_UPPER), less(_MARKS))


def _counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rule_counts(t) for t in texts], columns=COUNTS).astype("int64")


def counts_of(column: str) -> Column:
    return F.pandas_udf(_counts, ", ".join(f"{c} long" for c in COUNTS))(column)


def base_failed(prefix: str = "") -> Column:
    words, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 20) | (100 * repeated > 30 * words)


def features(counts: pd.DataFrame) -> np.ndarray:
    """Ratios of the counts, so that length alone is no anomaly."""
    c = {k: counts[k].to_numpy(np.float64) for k in COUNTS}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([c["word_chars"] / words, np.sqrt(c["n_symbols"] / chars), np.sqrt(c["n_dup_lines"] / lines), np.sqrt(c["n_repeat_words"] / words), np.sqrt(c["n_upper"] / chars), np.sqrt(c["n_marks"] / chars)])


@dataclass(frozen=True)
class Fit:
    """Bounds and shape of the fit. ``rows``: most labelled rows it uses; ``spared``: least share of good rows it must keep."""

    rows: int = 6000
    trees: int = 128
    sample: int = 256
    depth: int = 10
    spared: float = 0.998
    seed: int = 7


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth at which an unsuccessful search in a random tree over n rows ends."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random splits; ``score`` is 2 to the power of minus path length over its mean, near 1 for anomalies.

    Half of the cuts fall anywhere in the node's box, which at the root reaches one range beyond the rows on either side, the
    others between the node's rows. So values that no fitted row has are cut off early, by leaves without rows.
    """

    def __init__(self, rows: np.ndarray, fit: Fit):
        random = np.random.default_rng(fit.seed)
        size = 2 ** (fit.depth + 1) - 1
        self.depth, self.axis = fit.depth, np.full((fit.trees, size), -1, np.int8)
        self.cut, self.path = np.zeros((fit.trees, size), np.float32), np.zeros((fit.trees, size), np.float32)
        take = min(fit.sample, len(rows))
        margin = np.maximum(rows.max(0) - rows.min(0), 0.1)
        low, high = rows.min(0) - margin, rows.max(0) + margin
        self.mean = max(float(_average_path(take)), 1e-9)
        for t in range(fit.trees):
            self._grow(t, 0, 0, rows[random.choice(len(rows), take, replace=False)], low, high, random)

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray, random: np.random.Generator) -> None:
        self.path[t, node] = depth + _average_path(len(rows))
        if depth == self.depth or not len(rows):
            return
        axis = random.integers(len(low))
        near, far = (low, high) if random.random() < 0.5 else (rows.min(0), rows.max(0))
        if not far[axis] > near[axis]:
            near, far = low, high
        cut = np.float32(random.uniform(near[axis], far[axis]))
        left = rows[:, axis] < cut
        self.axis[t, node], self.cut[t, node] = axis, cut
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = cut
        self._grow(t, 2 * node + 1, depth + 1, rows[left], low, below, random)
        self._grow(t, 2 * node + 2, depth + 1, rows[~left], above, high, random)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for axis, cut, path in zip(self.axis, self.cut, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                a = axis[node]
                node = np.where(a < 0, node, 2 * node + 1 + (rows[every, a] >= cut[node]))
            total += path[node]
        return 2.0 ** (-total / len(self.axis) / self.mean)


def calibrate(scores: np.ndarray, good: np.ndarray, spared: float) -> float:
    """The score from which documents are dropped: best balanced accuracy among cut-offs that keep ``spared`` of the good rows."""
    least = np.quantile(scores[good], spared, method="higher")
    cuts = np.unique(np.append(scores[scores > least], np.nextafter(least, 2)))
    if good.all():
        return float(np.nextafter(scores.max(), 2))
    hit = [(scores[~good] >= c).mean() - (scores[good] >= c).mean() for c in cuts]
    return float(cuts[int(np.argmax(hit))])


def fit_rules(documents: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> tuple[IsolationForest, float] | None:
    """Forest and cut-off from at most ``fit.rows`` labelled rows, chosen by a hash of their id (the same at every partitioning)."""
    chosen = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_q"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.rows)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_q", counts_of("text").alias("c")).select("doc_id", "_q", "c.*")
    one = rows.groupBy("doc_id", "_q").agg(F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", "_q", "c.*")
    known = one.where(~base_failed()).toPandas()  # at most fit.rows
    known = known.sort_values("doc_id", key=lambda ids: [zlib.crc32(str(i).encode()) for i in ids], ignore_index=True)
    good = known["_q"].to_numpy() > 0
    if not good.any():
        return None
    x = features(known).astype(np.float32)
    grown = good & (np.cumsum(good) % 2 == 1)  # every other good row; the cut-off comes from the rows that the forest hasn't seen
    forest = IsolationForest(x[grown], fit)
    seen = ~grown if (good & ~grown).any() else np.ones(len(x), bool)
    return forest, calibrate(forest.score(x[seen]), good[seen], fit.spared)


def quality_rules(documents: DataFrame, model: tuple[IsolationForest, float] | None) -> DataFrame:
    """``documents`` with the counts, ``base_failed``, ``anomaly`` (0 to 1) and ``kept``; other columns stay, clashing ones are replaced."""

    @F.pandas_udf("double")
    def anomaly(counts: pd.DataFrame) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(counts)))
        return pd.Series(model[0].score(features(counts).astype(np.float32)))

    counted = documents.withColumn("__counts", counts_of("text"))
    counted = counted.withColumn("anomaly", anomaly("__counts")).withColumns({c: F.col("__counts")[c] for c in COUNTS}).drop("__counts")
    cut = 2.0 if model is None else model[1]
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < cut))
