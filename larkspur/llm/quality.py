"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text (FEATURES) are cut into at most BINS quantile bins. Boosting goes round the features:
each step fits a tree of depth two to one feature's gradient histogram and adds it, shrunk, to that feature's lookup
table. Then the PAIRS pairs whose best cross cut still lowers the loss most get tables over two features'
coarser bins, boosted in the same way. A score is the sum of table entries, through the logistic function.

Training uses at most `sample` labelled documents, those with the smallest hash of their id, one row for each id (see
toxicity.labelled); the driver holds their features only, 8 * len(FEATURES) bytes each.

Defined results: null and empty texts have zero features and are scored like any others, very long ones as a whole; without
usable labels of both classes every score is the smoothed share of 1; repeated rows are scored each. Extra columns pass through;
score and predicted are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard
from .text import SPACES, chunks, joined, mix, words
from .toxicity import labelled

SAMPLE, BINS, COARSE, PAIRS = 20_000, 64, 16, 6
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "stop", "exclaim", "pipe", "wide", "line_break",
    "distinct_words", "echoed_words", "distinct_pairs", "distinct_fives", "short_words", "stop_per_word", "distinct_lines",
)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "stop": b".,;:?",
    "exclaim": b"!",
    "pipe": b"|",
    "line_break": b"\n",
}
_BREAKS = np.zeros(256, bool)
_BREAKS[10] = True


def _table(some: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(some)] = 1
    return out


_TABLES = {k: _table(v) for k, v in _CLASSES.items()} | {"wide": (np.arange(256) >= 192).astype(np.uint8)}


def _distinct(n: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Share of distinct hashes by text; 1 where there is none."""
    key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    total = np.bincount(doc, minlength=n)
    return np.where(total, np.bincount(doc[order][new], minlength=n) / np.maximum(total, 1), 1.0)


def features(n: int, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each of n texts."""
    out = np.zeros((n, len(FEATURES)))
    col = {f: i for i, f in enumerate(FEATURES)}
    size = np.diff(offsets)
    w = words(buf, offsets, SPACES)
    count = np.bincount(w.doc, minlength=n)
    some, per = np.maximum(count, 1), np.maximum(size, 1)
    out[:, col["log_bytes"]], out[:, col["log_words"]] = np.log1p(size), np.log1p(count)
    out[:, col["word_bytes"]] = np.bincount(w.doc, w.end - w.start, n) / some
    full = np.flatnonzero(size > 0)
    for f, t in _TABLES.items():
        if len(full):
            out[full, col[f]] = np.add.reduceat(t[buf], offsets[:-1][full], dtype=np.int64) / per[full]
    out[:, col["distinct_words"]] = _distinct(n, w.doc, w.hash)
    both = w.doc[1:] == w.doc[:-1] if len(w.doc) else np.zeros(0, bool)
    echo = both & (w.hash[1:] == w.hash[:-1]) if len(w.doc) else both
    out[:, col["echoed_words"]] = np.bincount(w.doc[1:][echo], minlength=n) / some
    for k, f in ((2, "distinct_pairs"), (5, "distinct_fives")):
        h = joined(w.hash, k)
        same = w.doc[k - 1 :] == w.doc[: len(h)] if len(h) else np.zeros(0, bool)
        out[:, col[f]] = _distinct(n, w.doc[: len(h)][same], h[same])
    out[:, col["short_words"]] = np.bincount(w.doc, w.end - w.start <= 3, n) / some
    out[:, col["stop_per_word"]] = out[:, col["stop"]] * size / some
    lines = words(buf, offsets, _BREAKS)
    out[:, col["distinct_lines"]] = _distinct(n, lines.doc, lines.hash)
    return out


@dataclass
class Model:
    bias: float
    cuts: list[np.ndarray]  # by feature
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]  # over the bins of two features, halved to COARSE

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for i, t in enumerate(self.tables):
            z += t[b[:, i]]
        c = b * COARSE // BINS
        for i, j, t in self.pairs:
            z += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-z))


def _gain(g, h, ridge: float = 1.0):
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of cuts over ordered bins, as a value for each bin, from gradient sums by bin."""
    out = np.full(len(g), -g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        left, weight = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left, weight) + _gain(g.sum() - left, h.sum() - weight)
        gain[(weight < 2) | (h.sum() - weight < 2)] = -1
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            out[:k], out[k:] = _tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts over a grid of gradient sums: its gain, and a value for each cell."""
    G, H = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)

    def quarters(s):
        a = s[:-1, :-1]
        b, c = s[:-1, -1:] - a, s[-1:, :-1] - a
        return a, b, c, s[-1, -1] - a - b - c

    gs, hs = quarters(G), quarters(H)
    gain = sum(_gain(x, y) for x, y in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    parts = (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])
    for at, x, y in zip(parts, gs, hs, strict=True):
        out[at] = -x[i, j] / (y[i, j] + 1.0)
    return float(gain[i, j] - _gain(G[-1, -1], H[-1, -1])), out


def fit(y: np.ndarray, x: np.ndarray, rounds: int = 150, rate: float = 0.1) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS)) if len(y) else np.zeros(0) for i in range(width)]
    model = Model(bias, cuts, [np.zeros(BINS + 1) for _ in range(width)], [])
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    z = np.full(len(y), bias)

    def grads():
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for i in range(width):
            g, h = grads()
            step = rate * _tree(np.bincount(b[:, i], g, BINS + 1), np.bincount(b[:, i], h, BINS + 1))
            model.tables[i] += step
            z += step[b[:, i]]
    c = b * COARSE // BINS
    side = COARSE + 1

    def grid(i, j):
        g, h = grads()
        at = c[:, i] * side + c[:, j]
        return np.bincount(at, g, side * side).reshape(side, side), np.bincount(at, h, side * side).reshape(side, side)

    gains = sorted(((_cross(*grid(i, j))[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((side, side))) for _, i, j in gains[:PAIRS]]
    for _ in range(rounds // 3):
        for i, j, t in model.pairs:
            step = rate * _cross(*grid(i, j))[1]
            t += step
            z += step[c[:, i], c[:, j]]
    return model


def _feature_rows(texts: pa.Array) -> list[bytes]:
    return [r.tobytes() for i, j, buf, offsets in chunks(texts) for r in features(j - i, buf, offsets)]


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", sample: int = SAMPLE) -> Model:
    rows = labelled(docs, labels, label, use, sample, _feature_rows)
    read = rows.select("features", "label").toArrow()
    discard(rows)
    found = sorted(zip(read.column("features").to_pylist(), read.column("label").to_pylist(), strict=True))
    x = np.frombuffer(b"".join(v for v, _ in found), float).reshape(len(found), len(FEATURES))
    return fit(np.array([y for _, y in found], float), x)


def apply(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [held.value.score(features(j - i, buf, offsets)) for i, j, buf, offsets in chunks(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("score", score(F.coalesce("text", F.lit("")))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
