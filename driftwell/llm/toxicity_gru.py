"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word goes in as the embedding of itself (hashed) and the mean embedding of its character
3- and 4-grams (hashed, with marks for its ends), so forms never seen still look like
their stems. A document is all its windows of ``WINDOW`` words, each starting ``STRIDE``
words after the one before (the last ends with the document). The network reads a window
in both directions, pools its states by attention and gives a logit; the document's logit
is its windows' largest, brought to a probability by a logistic curve fitted on sampled
documents that the network was not trained on.

Labels are learnt from at most ``SAMPLE`` documents of each label (those with the smallest
hashes of doc_id, texts of at most ``SAMPLE_BYTES`` only, which bounds what the driver gets),
``PER_DOC`` windows of each in training; every window of every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import hashed_sample
from .quality_qda import _sigmoid, remainder

WINDOW, STRIDE, SAMPLE, PER_DOC, THRESHOLD = 24, 12, 2_000, 12, 0.7
SAMPLE_BYTES = 200_000
GRAMS, WORDS, CHAR_DIM, WORD_DIM, HIDDEN, ATTENTION = 1 << 15, 1 << 14, 12, 4, 8, 6
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
MARKS = ".,;:!?\"'()[]{}<>*&%$#|-_/\\"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


class Lexicon:
    """The distinct words of a batch: each one's hash bucket and the buckets of its character n-grams (``grams[at[i]:at[i+1]]``)."""

    def __init__(self, words: list[str]) -> None:
        raw = [f"\x02{w}\x03".encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw) + b"\0" * 8, np.uint8).astype(np.uint64)
        begin = np.concatenate([[0], np.cumsum(size)])
        total = int(begin[-1])
        h3 = data[:total] | data[1 : total + 1] << np.uint64(8) | data[2 : total + 2] << np.uint64(16)
        h4 = h3 | data[3 : total + 3] << np.uint64(24)
        ends = np.repeat(begin[1:], size)
        pos = np.arange(total)
        three, four = pos + 3 <= ends, pos + 4 <= ends
        word = np.repeat(np.arange(len(raw)), size)
        own, order = np.concatenate([word[three], word[four]]), None
        grams = np.concatenate([_mix(h3[three] * _A), _mix((h4[four] + np.uint64(1 << 40)) * _A)]) % np.uint64(GRAMS)
        order = np.argsort(own, kind="stable")
        self.grams = grams[order].astype(np.int64)
        self.count = np.bincount(own, minlength=len(raw))
        self.at = np.concatenate([[0], np.cumsum(self.count)])
        self.bucket = (pd.util.hash_array(np.array(words, dtype=object), categorize=False) % np.uint64(WORDS)).astype(np.int64) if words else np.empty(0, np.int64)

    def vectors(self, chars: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Input vectors of the words."""
        n = len(self.bucket)
        out = np.zeros((n, CHAR_DIM + WORD_DIM), np.float32)
        some = np.flatnonzero(self.count)
        for at in range(0, len(some), 20_000):
            part = some[at : at + 20_000]
            a, b = self.at[part[0]], self.at[part[-1] + 1]
            out[part, :CHAR_DIM] = np.add.reduceat(chars[self.grams[a:b]], self.at[part] - a, axis=0) / self.count[part][:, None]
        out[:, CHAR_DIM:] = word[self.bucket]
        return out


def read_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Lexicon]:
    """Word numbers of all texts on end, where each text's begin (one more at the end), and the words they number."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    clean = pc.utf8_trim(coded.dictionary, characters=MARKS)
    again = clean.dictionary_encode()
    ids = again.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
    return ids.astype(np.int64), at - at[0], Lexicon(again.dictionary.to_pylist())


def windows(at: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window; a text of no more than ``window`` words is one."""
    n = np.diff(at)
    many = np.maximum(1, -(-(n - window) // stride) + 1)
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = np.minimum(k * stride, np.maximum(0, n[text] - window))
    return text, at[text] + first, np.minimum(n[text], window)


class BiGru:
    """Parameters by name, the forward pass and, for training, the gradients."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        d, h = CHAR_DIM + WORD_DIM, HIDDEN
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"chars": 0.3 * rng.standard_normal((GRAMS, CHAR_DIM)).astype(np.float32), "word": 0.1 * rng.standard_normal((WORDS, WORD_DIM)).astype(np.float32)}
        for way in "fb":
            p |= {f"wx{way}": make(d, 3 * h), f"wh{way}": make(h, 3 * h), f"bx{way}": np.zeros(3 * h, np.float32)}
        self.p = p | {"wa": make(2 * h, ATTENTION), "va": make(ATTENTION, 1)[:, 0], "u": make(2 * h, 1)[:, 0], "c": np.zeros(1, np.float32)}

    def forward(self, inputs: dict, ids: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Logits of windows. ``inputs``: by way, each word's part of the gates; ``ids``: (words, windows), padded at the end."""
        p, h, (steps, n) = self.p, HIDDEN, ids.shape
        states, kept = np.empty((steps, n, 2 * h), np.float32), {}
        inside = np.arange(steps)[:, None] < sizes[None]
        for k, way in enumerate("fb"):
            wh, s = p[f"wh{way}"], np.zeros((n, h), np.float32)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                x, r = inputs[way][ids[t]], s @ wh
                zr = 1 / (1 + np.exp(-(x[:, : 2 * h] + r[:, : 2 * h])))
                z = zr[:, :h]
                if not inside[t].all():
                    z = np.where(inside[t][:, None], z, np.float32(1))
                new = np.tanh(x[:, 2 * h :] + zr[:, h:] * r[:, 2 * h :])
                if keep:
                    kept[way, t] = (s, z, zr[:, h:], new, r[:, 2 * h :])
                s = new + z * (s - new)
                states[t, :, k * h : (k + 1) * h] = s
        hidden = np.tanh(states @ p["wa"])
        e = hidden @ p["va"]
        e = np.where(inside, e, np.float32(-30))
        e = np.exp(e - e.max(0))
        a = e / e.sum(0)
        pooled = (a[:, :, None] * states).sum(0) * (sizes > 0)[:, None]
        logit = pooled @ p["u"] + p["c"][0]
        return (logit, (states, inside, hidden, a, pooled, kept)) if keep else logit

    def inputs(self, x: np.ndarray) -> dict:
        return {way: x @ self.p[f"wx{way}"] + self.p[f"bx{way}"] for way in "fb"}

    def gradients(self, lex: Lexicon, ids: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        """Gradients of the mean log-loss and the loss itself."""
        p, h, (steps, n) = self.p, HIDDEN, ids.shape
        x = lex.vectors(p["chars"], p["word"])
        logit, (states, inside, hidden, a, pooled, kept) = self.forward(self.inputs(x), ids, sizes, keep=True)
        q = _sigmoid(logit.astype(np.float64))
        loss = float(-(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9)).mean())
        d = ((q - y) / n).astype(np.float32)
        g = {"u": pooled.T @ d, "c": d.sum(keepdims=True)}
        dp = d[:, None] * p["u"] * (sizes > 0)[:, None]
        da = (states * dp).sum(2)
        ds = a[:, :, None] * dp
        de = a * (da - (a * da).sum(0)) * inside
        g["va"] = np.tensordot(hidden, de, ((0, 1), (0, 1)))
        dh = de[:, :, None] * p["va"] * (1 - hidden**2)
        g["wa"] = np.tensordot(states, dh, ((0, 1), (0, 1)))
        ds = ds + dh @ p["wa"].T
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            wh, back = p[f"wh{way}"], np.zeros((n, h), np.float32)
            gx, gh = np.zeros((len(x), 3 * h), np.float32), np.zeros_like(wh)
            for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
                s, z, r, new, rec = kept[way, t]
                back = back + ds[t, :, k * h : (k + 1) * h]
                on = inside[t][:, None]
                dn = back * (1 - z) * (1 - new**2)
                dz = np.where(on, back * (s - new) * z * (1 - z), 0)
                dr = dn * rec * r * (1 - r)
                gates = np.concatenate([dz, dr, dn], 1)
                np.add.at(gx, ids[t], np.where(on, gates, 0))
                inner = np.concatenate([dz, dr, dn * r], 1)
                gh += s.T @ inner
                back = back * z + inner @ wh.T
            g[f"wh{way}"], g[f"wx{way}"], g[f"bx{way}"] = gh, x.T @ gx, gx.sum(0)
            dx += gx @ p[f"wx{way}"].T
        g["chars"], g["word"] = np.zeros_like(p["chars"]), np.zeros_like(p["word"])
        each = np.repeat(np.arange(len(x)), lex.count)
        np.add.at(g["chars"], lex.grams, (dx[:, :CHAR_DIM] / np.maximum(lex.count, 1)[:, None])[each])
        np.add.at(g["word"], lex.bucket, dx[:, CHAR_DIM:])
        return g, loss


def _pad(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(words, windows) of word numbers; short windows are padded with the last word number there is."""
    steps = max(1, int(sizes.max(initial=0)))
    at = np.minimum(first[None] + np.arange(steps)[:, None], max(0, len(ids) - 1))
    return ids[at] if len(ids) else np.zeros(at.shape, np.int64)


def fit(texts: list[str], y: np.ndarray, rounds: int = 5, batch: int = 512, rate: float = 0.02, seed: int = 5, least: int = 200) -> BiGru:
    """Adam on windows that carry their text's label: two rounds on up to ``PER_DOC`` windows of each text taken at random, then rounds on the windows that the network ranks highest, a third as many for texts of label 1 (most of whose windows are harmless). Small samples get more rounds, to ``least`` steps or so."""
    net, rng = BiGru(seed), np.random.default_rng(seed)
    all_texts = pa.array(texts, pa.string())
    ids, at, lex = read_words(all_texts)
    text, first, sizes = windows(at)
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    some = min(len(text), PER_DOC * len(texts))
    batch = max(16, min(batch, some // 8))
    rounds = max(rounds, -(-least * batch // max(1, some)))
    for turn in range(rounds):
        value = rng.random(len(text)) if turn < 2 else -window_logits(net, ids, lex, first, sizes)
        by = np.lexsort((value, text))
        nth = np.arange(len(by)) - np.searchsorted(text[by], text[by])
        order = rng.permutation(by[nth < np.where((y[text[by]] == 1) & (turn >= 2), max(1, PER_DOC // 3), PER_DOC)])
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            words = _pad(ids, first[own], sizes[own])
            used, local = np.unique(words, return_inverse=True)
            g, _ = net.gradients(_some(lex, used), local.reshape(words.shape), sizes[own], y[text[own]].astype(np.float64))
            step += 1
            speed = rate * (1 - turn / rounds) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, x in net.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                x -= (speed * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return net


def window_logits(net: BiGru, ids: np.ndarray, lex: Lexicon, first: np.ndarray, sizes: np.ndarray, batch: int = 4_096) -> np.ndarray:
    """The logit of each window, shorter windows first so that batches need little padding."""
    inputs = net.inputs(lex.vectors(net.p["chars"], net.p["word"]))
    if not len(lex.bucket):
        inputs = {k: np.zeros((1, 3 * HIDDEN), np.float32) for k in "fb"}
    out, order = np.empty(len(sizes)), np.argsort(sizes, kind="stable")
    for i in range(0, len(order), batch):
        own = order[i : i + batch]
        out[own] = net.forward(inputs, _pad(ids, first[own], sizes[own]), sizes[own])
    return out


def _some(lex: Lexicon, used: np.ndarray) -> Lexicon:
    """The lexicon of some of its words."""
    out = object.__new__(Lexicon)
    out.count, out.bucket = lex.count[used], lex.bucket[used]
    out.at = np.concatenate([[0], np.cumsum(out.count)])
    out.grams = lex.grams[np.repeat(lex.at[used] - out.at[:-1], out.count) + np.arange(out.at[-1])]
    return out


def logits(net: BiGru, texts: pa.Array) -> np.ndarray:
    """The largest logit of each text's windows."""
    ids, at, lex = read_words(texts)
    text, first, sizes = windows(at)
    out = np.full(len(at) - 1, -np.inf)
    np.maximum.at(out, text, window_logits(net, ids, lex, first, sizes))
    return out


class Model:
    """A network and the curve from a document's logit to a probability."""

    def __init__(self, net: BiGru | None, a: float, b: float) -> None:
        self.net, self.a, self.b = net, a, b

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), float(_sigmoid(np.array(self.b))))
        return _sigmoid(self.a * logits(self.net, texts) + self.b)


def _calibrated(net: BiGru, texts: list[str], y: np.ndarray, weight: np.ndarray) -> Model:
    t = logits(net, pa.array(texts, pa.string()))
    s, w = t.std() + 1e-9, np.array([1.0, 0.0])
    mid = t.mean()
    x = np.stack([(t - mid) / s, np.ones(len(t))], 1)
    for _ in range(100):
        q = _sigmoid(x @ w)
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (weight * (q - y)) + 1e-2 * w), -1, 1)
    a = max(float(w[0] / s), 1e-6)
    return Model(net, a, float(w[1] - a * mid))


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each label for which ``learn`` holds, a quarter of them for the curve only.

    Labels that repeat an id count once (toxic if one of them is), documents that repeat it each.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & learn)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    rates = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(rates.values())
    ids = [hashed_sample(known.filter(F.col("y") == k), "doc_id", sample, rates.get(k, 0)) for k in (0, 1)]
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES).join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    got = got.limit(4 * sample).toPandas().sort_values(["doc_id", "text"], ignore_index=True)[: 2 * sample]
    got = got.sample(frac=1, random_state=3, ignore_index=True)
    if got["y"].nunique() < 2 or len(got) < 8:
        return Model(None, 1.0, float(np.log((rates.get(1, 0) + 1) / (rates.get(0, 0) + 1))))
    y, texts = got["y"].to_numpy(), [t or "" for t in got["text"]]
    back = pd.Series(y).groupby(y).cumcount().to_numpy() % 4 == 0
    net = fit([t for t, b in zip(texts, back, strict=True) if not b], y[~back])
    # the sample holds the labels in other shares than the table
    weight = np.array([rates[0] / total / max(1, (y[back] == 0).sum()), rates[1] / total / max(1, (y[back] == 1).sum())])[y[back]] * back.sum()
    return _calibrated(net, [t for t, b in zip(texts, back, strict=True) if b], y[back], weight)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts are one window of one empty word. Rows that repeat a doc_id are scored each
    by its own text. A null doc_id is not held out and never learnt from. Without both labels every score is the labels' base rate. An empty
    table gives an empty result; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, remainder(F.col("doc_id"), 3) != 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(held.value.score(part.column("text")), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
