"""Toxicity: a factorization machine over hashed terms.

Terms of a text: its words, their first 5 and 7 bytes, and pairs of neighbouring words, each hashed to
SPACE buckets. Training keeps the buckets that tell the classes apart (z score over documents), alone or in pairs, and
fits bias + sum of weights + sum over pairs of the inner product of their latent vectors, so that two
terms which are harmless alone can count together. Terms are present or absent; texts are read whole.

Training uses at most `sample` labelled documents, those with the smallest hash of their id, one row for each id, and of these as many, in
this order, as have `most` distinct terms together (more than `sample` documents of ordinary length have). So the driver holds at most 4 * most bytes of terms.
Terms that tell nothing alone are kept where they tell the classes apart together with another: of the PAIRED strongest that would go, those in a pair that
does. Scoring knows no bounds.

Defined results: null and empty texts get the bias's score; a very long text is scored as a whole; a document with a null or conflicting label
is no training row (repeated equal labels count once); of rows that repeat an id one teaches, and each is scored; without usable labels of both classes
every score is the smoothed share of 1. Extra columns pass through; score and predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize
from .text import OTHERS, chunks, hash_of, joined, words

SPACE, FACTORS, SAMPLE, MOST_TERMS = 1 << 20, 8, 12_000, 32 << 20
PAIRED = 1024


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each term occurrence."""
    w = words(buf, offsets, OTHERS)
    doc, out = [w.doc], [w.hash]
    for k in (5, 7):
        longer = w.end - w.start > k
        doc.append(w.doc[longer])
        out.append(hash_of(w.sums, w.start[longer], w.start[longer] + k) + np.uint64(k))
    if len(w.hash) > 1:
        both = w.doc[1:] == w.doc[:-1]
        doc.append(w.doc[1:][both])
        out.append(joined(w.hash, 2)[both])
    return np.concatenate(doc), (np.concatenate(out) >> np.uint64(44)).astype(np.int64)


@dataclass
class Machine:
    bias: float
    slot: np.ndarray  # of each bucket: its place in weights, or -1
    weights: np.ndarray
    factors: np.ndarray

    def score(self, n: int, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        s = self.slot[bucket]
        some = s >= 0
        pairs = np.unique(doc[some] * len(self.weights) + s[some]) if some.any() else np.zeros(0, np.int64)
        d, s = np.divmod(pairs, max(len(self.weights), 1))
        z = self.bias + np.bincount(d, self.weights[s], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[s, f]
            z += 0.5 * (np.bincount(d, v, n) ** 2 - np.bincount(d, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _together(rows: list[np.ndarray], labels: np.ndarray, weak: np.ndarray, share: float, least: int, z: float) -> np.ndarray:
    """Which of the weak buckets are in a pair, of two of them, that tells the classes apart. There are half of PAIRED squared pairs, so
    the score asked for is 1.75 times that for one term."""
    slot = np.full(SPACE, -1, np.int32)
    slot[weak] = np.arange(len(weak))
    both, bad = np.zeros((len(weak), len(weak)), np.float32), np.zeros((len(weak), len(weak)), np.float32)
    for i in range(0, len(rows), 512):
        some = np.zeros((len(rows[i : i + 512]), len(weak)), np.float32)
        for line, r in zip(some, rows[i : i + 512], strict=True):
            s = slot[r]
            line[s[s >= 0]] = 1
        both += some.T @ some
        some = some[labels[i : i + 512] > 0]
        bad += some.T @ some
    apart = (bad - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 1e-9))
    found = (both >= least) & (np.abs(apart) >= 1.75 * z)
    np.fill_diagonal(found, False)
    return found.any(0)


def fit(labels: np.ndarray, rows: list[np.ndarray], epochs: int = 25, rate: float = 0.1, l2: float = 2e-4, least: int = 6, z: float = 4.0) -> Machine:
    """rows: the distinct buckets of each document."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    none = Machine(bias, np.full(SPACE, -1, np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    if not len(labels) or labels.min() == labels.max():
        return none
    n, toxic = np.zeros(SPACE, np.int32), np.zeros(SPACE, np.int32)
    for i in range(0, len(rows), 256):  # a few rows at once: the sample's terms stand once in memory
        some = rows[i : i + 256]
        n += np.bincount(np.concatenate(some), minlength=SPACE).astype(np.int32)
        bad = [r for r, y in zip(some, labels[i : i + 256], strict=True) if y]
        if bad:
            toxic += np.bincount(np.concatenate(bad), minlength=SPACE).astype(np.int32)
    apart = (toxic - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    enough = n >= least
    kept = np.flatnonzero(enough & (np.abs(apart) >= z))
    weak = np.flatnonzero(enough & (np.abs(apart) < z))
    weak = weak[np.argsort(-np.abs(apart[weak]), kind="stable")[:PAIRED]]
    kept = np.union1d(kept, weak[_together(rows, labels, weak, share, least, z)])
    if not len(kept):
        return none
    slot = np.full(SPACE, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    found = [s[s >= 0] for s in (slot[r] for r in rows)]
    term = np.concatenate(found).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(s) for s in found])
    rng = np.random.default_rng(7)
    w, v = np.zeros(len(kept)), rng.normal(0, 0.1, (len(kept), FACTORS))
    w2, v2, b2 = np.full(len(kept), 1e-3), np.full(v.shape, 1e-3), 1e-3
    first = np.searchsorted(doc, np.arange(len(rows) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(rows) // 128)):
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            t, d = term[at], np.repeat(np.arange(len(part)), first[part + 1] - first[part])
            sums = np.stack([np.bincount(d, v[t, f], len(part)) for f in range(FACTORS)], 1)
            squares = np.bincount(d, (v[t] ** 2).sum(1), len(part))
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(d, w[t], len(part)) + 0.5 * ((sums**2).sum(1) - squares), -30, 30)))
            e = (p - labels[part]) / len(part)
            u, inverse = np.unique(t, return_inverse=True)
            gw = np.bincount(inverse, e[d], len(u)) + l2 * w[u]
            gv = np.stack([np.bincount(inverse, e[d] * (sums[d, f] - v[t, f]), len(u)) for f in range(FACTORS)], 1) + l2 * v[u]
            w2[u] += gw**2
            v2[u] += gv**2
            w[u] -= rate * gw / np.sqrt(w2[u])
            v[u] -= rate * gv / np.sqrt(v2[u])
            b2 += (g := e.sum()) ** 2
            bias -= rate * g / b2**0.5
    return Machine(float(bias), slot, w, v)


def _term_rows(texts: pa.Array) -> list[bytes]:
    """Each text's distinct buckets."""
    out = []
    for i, j, buf, offsets in chunks(texts):
        doc, bucket = terms(buf, offsets)
        pairs = np.unique(doc * SPACE + bucket)
        at = np.searchsorted(pairs, np.arange(j - i + 1) * SPACE)
        out += [(pairs[a:b] % SPACE).astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, use: Column, sample: int, features: Callable[[pa.Array], list[bytes]]) -> DataFrame:
    """rank long, label int, features binary: the sample to train on, a written table of at most `sample` rows. One row for each chosen id: of rows
    that repeat an id, that with the smallest hash of its text; ranked by a hash of the id. use: which doc_ids may teach."""
    one = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & use)
        .groupBy("doc_id").agg(F.min(label).alias("__label"), F.max(label).alias("__other"))
        .filter(F.col("__label") == F.col("__other"))
    )
    rank = F.xxhash64(F.lit(17), "doc_id")
    # the bound comes first: only chosen ids meet the texts
    some = one.select("doc_id", F.col("__label").cast("int").alias("label"), rank.alias("rank")).orderBy("rank", "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")  # at most sample rows of three numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, least = TaskContext.get().partitionId(), {}  # by rank: the smallest hash so far; a larger one cannot be chosen
        for batch in batches:
            keep = []
            for i, (r, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if r not in least or h < least[r]:
                    least[r] = h
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            found = [batch.column(i).take(at) for i in range(3)]
            rows = features(batch.column(3).take(at))
            yield pa.record_batch([*found, pa.array([part] * len(keep), pa.int64()), pa.array(rows, pa.binary())], names=["rank", "label", "h", "part", "features"])

    seen = materialize(texts.select("rank", "label", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "rank long, label int, h long, part long, features binary"), "labelled")
    best = seen.groupBy("rank").agg(F.min(F.struct("h", "part")).alias("best"))
    chosen = seen.join(F.broadcast(best), "rank").filter(F.struct("h", "part") == F.col("best"))  # best: at most sample rows of three numbers
    out = materialize(chosen.select("rank", "label", "features"), "sample")
    discard(seen)
    return out


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "toxic", sample: int = SAMPLE, most: int = MOST_TERMS) -> Machine:
    """The sample's documents, by rank, that have `most` distinct terms together; the driver reads no more than these."""
    rows = labelled(docs, labels, label, use, sample, _term_rows)
    sizes = rows.select("rank", (F.octet_length("features") / 4).cast("long").alias("n")).toArrow()  # two numbers a document of the sample
    rank, n = sizes.column("rank").to_numpy(), sizes.column("n").to_numpy()
    order = np.argsort(rank, kind="stable")
    fits = order[np.cumsum(n[order]) <= most]
    chosen = rows if len(fits) == len(order) else rows.filter(F.col("rank") <= F.lit(int(rank[fits[-1]]))) if len(fits) else rows.limit(0)
    read = chosen.select("features", "label").toArrow()
    discard(rows)
    found = sorted(zip(read.column("features").to_pylist(), read.column("label").to_pylist(), strict=True))
    del read
    return fit(np.array([y for _, y in found], float), [np.frombuffer(t, np.int32) for t, _ in found])


def apply(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [held.value.score(j - i, *terms(buf, offsets)) for i, j, buf, offsets in chunks(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("score", score(F.coalesce("text", F.lit("")))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
