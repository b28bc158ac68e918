"""Language identification by a byte convolutional network trained in numpy.

Filters of several widths run over bytes, are max-pooled over a window and feed a softmax. A text is cut into fixed-length
windows, every one is scored, and the windows' log-probabilities are averaged by their letters. The fit uses windows spread
over at most ``Fit.rows`` labelled rows, one of each id and about as many of each language, chosen by a hash of their id;
rows whose crc32(id) mod 4 is 2 are held out.

Defined cases: a null text or one without letters gives ``und`` with score 0, and so does every text if no row is labelled;
a null id is not held out and not learned from; equal scores go to the language that comes first by code point; repeated rows
each get their result; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, release

UNKNOWN = "und"
#: Leading bits of the hash by which ids are counted; most languages whose table is broadcast.
_BITS, _FEW = 10, 100_000
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are neither letters of ASCII nor part of a longer character become spaces.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Fit:
    """``rows``: most labelled rows of the fit; ``spread``: windows of each."""

    rows: int = 4000
    spread: int = 3
    window: int = 192
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    steps: int = 500
    batch: int = 128
    rate: float = 0.02
    seed: int = 5


def folded(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode().translate(_FOLD), np.uint8)


def windows(data: np.ndarray, width: int) -> np.ndarray:
    """The whole text as rows of ``width`` bytes, the last filled up with spaces."""
    rows = -(-len(data) // width)
    out = np.full(rows * width, 32, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, width)


class Network:
    """Convolution tables by width and offset (256 x filters), biases, and the softmax layer."""

    def __init__(self, languages: list[str], fit: Fit):
        random = np.random.default_rng(fit.seed)
        self.languages, self.fit = languages, fit
        self.tables = [[random.normal(0, 0.3, (256, fit.filters)).astype(np.float32) for _ in range(w)] for w in fit.widths]
        self.bias = [np.zeros(fit.filters, np.float32) for _ in fit.widths]
        self.out = random.normal(0, 0.1, (fit.filters * len(fit.widths), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self._pairs = None

    def _loss_step(self, x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Gradients of the mean cross-entropy, as (parameter, gradient)."""
        pooled, where = [], []
        for tables, bias in zip(self.tables, self.bias, strict=True):
            span = x.shape[1] - len(tables) + 1
            sums = sum(t[x[:, k : k + span]] for k, t in enumerate(tables))
            at = sums.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(sums, at[:, None], 1)[:, 0] + bias)
        features = np.concatenate(pooled, 1)
        active = np.maximum(features, 0)
        logits = active @ self.out + self.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        grads = [(self.out, active.T @ p + 1e-4 * self.out), (self.out_bias, p.sum(0))]
        back = (p @ self.out.T) * (features > 0)
        f = self.fit.filters
        for i, (tables, bias, at) in enumerate(zip(self.tables, self.bias, where, strict=True)):
            g = back[:, i * f : (i + 1) * f]
            grads.append((bias, g.sum(0)))
            for k, t in enumerate(tables):
                full = np.zeros_like(t)
                np.add.at(full, (np.take_along_axis(x, at + k, 1), np.arange(f)[None]), g)
                grads.append((t, full))
        return grads

    def train(self, x: np.ndarray, y: np.ndarray) -> "Network":
        """Adam over random batches."""
        random, memory = np.random.default_rng(self.fit.seed + 1), {}
        for step in range(1, self.fit.steps + 1):
            pick = random.integers(0, len(x), self.fit.batch)
            rate = self.fit.rate * (1 - step / (self.fit.steps + 1))
            for value, grad in self._loss_step(x[pick], y[pick]):
                m, v = memory.setdefault(id(value), (np.zeros_like(value), np.zeros_like(value)))
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of windows x languages; two offsets of a filter are looked up at once."""
        if self._pairs is None:
            join = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
            self._pairs = [[join(t[k], t[k + 1]) if k + 1 < len(t) else t[k] for k in range(0, len(t), 2)] for t in self.tables]
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for tables, bias, single in zip(self._pairs, self.bias, self.tables, strict=True):
            span = x.shape[1] - len(single) + 1
            total = None
            for k, t in enumerate(tables):
                part = np.take(t, (pair if len(t) > 256 else x)[:, 2 * k : 2 * k + span], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(total.max(1) + bias)
        logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.out_bias
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, weight = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        held, owners, count = [], [], 0

        def flush():
            nonlocal held, owners, count
            if held:
                rows, owner = np.concatenate(held), np.concatenate(owners)
                for k in range(0, len(rows), 256):
                    part = rows[k : k + 256]
                    letters = (part != 32).sum(1) + 1e-9
                    np.add.at(total, owner[k : k + 256], self.log_probabilities(part) * letters[:, None])
                    np.add.at(weight, owner[k : k + 256], letters)
            held, owners, count = [], [], 0

        for i, text in enumerate(texts):
            if text and _LETTER.search(text):
                rows = windows(folded(text), self.fit.window)
                held.append(rows), owners.append(np.full(len(rows), i))
                count += len(rows)
                if count > 4096:
                    flush()
        flush()
        known = np.flatnonzero(weight)
        mean = total[known] / weight[known][:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, row in zip(known, p, strict=True):
            names[i], scores[i] = self.languages[int(row.argmax())], row.max()
        return names, scores


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_language(documents: DataFrame, fit: Fit = Fit()) -> Network | None:
    """The network learned from rows that are not held out; None if none is labelled.

    Each language's ids are taken in the order of their hash until ``fit.rows`` are full, in turn, so rare languages aren't lost.
    Ids are counted by language and leading bits of the hash first; only those that can be chosen are ranked.
    """
    rows = (
        documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
        .withColumn("_h", F.xxhash64("doc_id"))
    )
    ids = materialize(rows.select("lang", "_h", "doc_id", F.shiftright("_h", 64 - _BITS).cast("int").alias("_b")).distinct(), "ids")
    counts = ids.groupBy("lang", "_b").count()  # at most two to the power of _BITS rows a language
    before = F.sum("count").over(Window.partitionBy("lang").orderBy("_b")) - F.col("count")
    last = counts.withColumn("_before", before).where(F.col("_before") < fit.rows).groupBy("lang").agg(F.max("_b").alias("_last"))
    last = materialize(last, "last")  # one row a language
    near = ids.join(F.broadcast(last) if last.count() <= _FEW else last, "lang").where("_b <= _last")
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_r") <= fit.rows)
    chosen = ranked.orderBy("_r", "_h", "doc_id", "lang").limit(fit.rows).select("_h", "doc_id", "lang")

    def pick(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            w = windows(folded(t), fit.window)
            out.append(w[np.unique(np.linspace(0, max(len(w) - 2, 0), fit.spread).astype(int))].tobytes() if len(w) else b"")
        return pd.Series(out, dtype=object)

    read = rows.join(F.broadcast(chosen), ["_h", "doc_id", "lang"], "left_semi").select("_h", "doc_id", "lang", F.pandas_udf(pick, "binary")("text").alias("w"))
    with bounded_batches(documents.sparkSession):
        known = read.groupBy("_h", "doc_id", "lang").agg(F.min("w").alias("w")).toPandas()  # at most fit.rows
    known = known.sort_values(["_h", "doc_id", "lang", "w"], ignore_index=True)
    cut = [np.frombuffer(w, np.uint8).reshape(-1, fit.window) for w in known["w"]]
    x = np.concatenate(cut) if cut else np.empty((0, fit.window), np.uint8)
    y = np.repeat(known["lang"].to_numpy(), [len(c) for c in cut]) if cut else np.empty(0, object)
    usable = (x != 32).sum(1) > 3
    if not usable.any():
        return None
    languages = sorted(set(y[usable]))
    return Network(languages, fit).train(x[usable], np.searchsorted(languages, y[usable].astype(str)))


def identified(network: Network | None, column: str = "text") -> Column:
    """Struct (lang_pred, score) of a text column; only the text is an input."""

    def run(texts: pd.Series) -> pd.DataFrame:
        names, scores = network.predict(list(texts)) if network else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
        release()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return F.pandas_udf(run, "lang_pred string, score double")(column)


def identify(documents: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every document."""
    with bounded_batches(documents.sparkSession):
        return materialize(documents.select("doc_id", held_out().alias("held_out"), identified(network).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score"), "languages")


#: Least score of a document that the filter keeps.
LEAST = 0.5


def keep_identified(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """Documents whose language is recognised with at least this score; columns stay."""
    network = train_language(documents)
    columns = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.withColumn("__p", identified(network))
    with bounded_batches(documents.sparkSession):
        return materialize(rows.where((F.col("__p.lang_pred") != UNKNOWN) & (F.col("__p.score") >= least)).select(*columns), "identified")
