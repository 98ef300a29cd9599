"""A quality classifier by regularised quadratic discriminant analysis.

Every text becomes a vector of document statistics (shares of kinds of characters, words,
lines and repeats), each transformed to be nearer to a normal distribution. Each label has
a mean and a covariance, shrunk towards the labels' pooled covariance and towards a multiple of the
identity; how much is chosen on parts of the sample held back in turn. A score is the difference of
the two Mahalanobis log-densities, from Cholesky factors computed and inverted once, brought to a
probability by a logistic curve fitted on the parts held back.

Labels are learnt from at most ``SAMPLE`` labelled rows (those with the smallest hashes of
doc_id); statistics are computed for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import hashed_sample, lean

SAMPLE, FOLDS, THRESHOLD = 40_000, 4, 0.3
_KINDS = ["lower", "upper", "digit", "space", "newline", "stop", "shout", "bar", "bracket", "symbol", "high"]


def _table() -> np.ndarray:
    t = np.full(256, _KINDS.index("symbol"), np.uint8)
    t[128:] = _KINDS.index("high")
    for kind, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t\r\x0b\x0c"), ("newline", "\n"), ("stop", ".,;:'\"-"), ("shout", "!?"), ("bar", "|"), ("bracket", "()[]{}<>/\\")):
        t[[ord(c) for c in chars]] = _KINDS.index(kind)
    return t


_TABLE = _table()
NAMES = [*_KINDS, "log_chars", "log_words", "word_length", "word_spread", "distinct_words", "marked_words", "longest_word", "log_lines", "distinct_lines", "distinct_pairs"]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text; null counts as empty."""
    texts = pc.fill_null(texts, "")
    raw = [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    out = np.zeros((len(raw), len(NAMES)))
    for i, b in enumerate(raw):
        n = len(b)
        kinds = np.bincount(_TABLE[np.frombuffer(b, np.uint8)], minlength=len(_KINDS)) if n else np.zeros(len(_KINDS))
        big = sum(b.count(bytes([0xC3, c])) for c in (0x84, 0x89, 0x87, 0x8A, 0x91, 0x93, 0x96, 0x9C)) if kinds[-1] else 0
        kinds = kinds.astype(float)
        kinds[1] += big
        words, lines = b.split(), b.split(b"\n")
        size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
        marked = sum(map(_marked, words))
        m = max(1, len(words))
        # logits of shares, with one character or word more on either side
        out[i, : len(_KINDS)] = np.log((kinds + 1) / (n - np.minimum(kinds, n) + 1 + n * 1e-3))
        pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 1
        out[i, len(_KINDS) :] = (
            np.log1p(n), np.log1p(len(words)), np.log1p(size.mean()), np.log1p(size.std()), _logit(len(set(words)), m), _logit(marked, m),
            np.log1p(size.max()), np.log1p(len(lines)), _logit(len(set(lines)), len(lines)), _logit(pairs, max(1, len(words) - 1)),
        )
    return out


def _marked(word: bytes) -> bool:
    """Whether the word ends in neither a letter, a digit nor usual punctuation."""
    c = word[-1]
    return c < 128 and _TABLE[c] > 5


def _logit(k: float, n: float) -> float:
    return float(np.log((k + 0.5) / (n - min(k, n) + 0.5)))


@dataclass
class Qda:
    """Means, inverses of the Cholesky factors of the shrunk covariances and what goes with them; ``a`` and ``b`` make a probability of a difference."""

    mid: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    logs: list[float]
    a: float = 1.0
    b: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mid) / self.scale
        density = []
        for mean, inverse, log in zip(self.means, self.inverses, self.logs, strict=True):
            y = (z - mean) @ inverse.T
            density.append(log - 0.5 * (y**2).sum(1))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.a * self.difference(x) + self.b)


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -500, 500)))


def _shrunk(x: np.ndarray, y: np.ndarray, to_all: float, to_one: float) -> Qda:
    mid, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mid) / scale
    d = z.shape[1]
    parts = [z[y == k] for k in (0, 1)]
    every = sum(len(p) * np.atleast_2d(np.cov(p.T, bias=True)) for p in parts if len(p) > 1) / len(z) + 1e-9 * np.eye(d)
    means, inverses, logs = [], [], []
    for p in parts:
        own = np.cov(p.T, bias=True) if len(p) > 1 else every
        c = (1 - to_all) * own + to_all * every
        c = (1 - to_one) * c + to_one * max(np.trace(c) / d, 1e-6) * np.eye(d)
        f = np.linalg.cholesky(c)
        means.append(p.mean(0) if len(p) else np.zeros(d))
        inverses.append(np.linalg.inv(f))
        logs.append(-np.log(np.diag(f)).sum() + np.log((len(p) + 1) / (len(z) + 2)))
    return Qda(mid, scale, means, inverses, logs)


def _curve(t: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (t, y), by Newton's method with a small ridge."""
    s = t.std() + 1e-9
    w = np.array([1.0, 0.0])
    x = np.stack([t / s, np.ones(len(t))], 1)
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w), -2, 2)
    return max(float(w[0] / s), 1e-6), float(w[1])


def fit(x: np.ndarray, y: np.ndarray) -> Qda:
    """The shrinkage and the curve with the least log-loss on parts held back in turn, refitted on all rows. One label alone gives a constant."""
    if len(np.unique(y)) < 2:
        q = _shrunk(np.vstack([x, np.zeros((1, len(NAMES)))]), np.append(y, 1), 1.0, 0.5)
        q.a, q.b = 1e-6, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return q
    fold = np.empty(len(y), np.int64)
    for k in (0, 1):  # each label is dealt evenly
        own = np.flatnonzero(y == k)
        fold[own] = np.arange(len(own)) % FOLDS
    best, least = None, np.inf
    for to_all in (0.02, 0.1, 0.3, 0.6):
        for to_one in (0.01, 0.05, 0.2):
            t = np.empty(len(y))
            for f in range(FOLDS):
                t[fold == f] = _shrunk(x[fold != f], y[fold != f], to_all, to_one).difference(x[fold == f])
            a, b = _curve(t, y)
            p = np.clip(_sigmoid(a * t + b), 1e-9, 1 - 1e-9)
            loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
            if loss < least:
                best, least = (to_all, to_one, a, b), loss
    q = _shrunk(x, y, *best[:2])
    q.a, q.b = best[2:]
    return q


def remainder(doc_id: Column, k: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column("text"))
            at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Qda | None:
    """Fit on at most ``sample`` labelled documents for which ``learn`` holds; None without any.

    The sample's ids and labels, which the bound makes small, are broadcast to the scan.
    Labels that repeat an id count once, documents that repeat it each.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & learn)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    known = hashed_sample(known, "doc_id", sample, known.count())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    got = features(own.select("doc_id", "text")).join(F.broadcast(known), "doc_id").limit(2 * sample).toPandas()
    if got.empty:
        return None
    x = np.stack(got["x"])
    order = np.lexsort((*x.T, got["doc_id"].to_numpy()))[:sample]
    order = order[np.random.default_rng(3).permutation(len(order))]
    return fit(x[order], got["y"].to_numpy()[order])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts are scored by the statistics of no characters. A null doc_id is
    not held out and never learnt from; without labels every score is 0.5. An empty table
    gives an empty result; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, remainder(F.col("doc_id"), 5) != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.value.score(statistics(b.column("text"))) if model.value else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns; the same text always fares alike. Without labels all stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, remainder(F.col("doc_id"), 5) != 0))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            s = model.value.score(statistics(pa.array(text, pa.string()))) if model.value else np.ones(len(text))
            yield pd.Series(s >= THRESHOLD)

    kept = lean(run)

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from kept(batches)

    return docs.filter(good("text"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
