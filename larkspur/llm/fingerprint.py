"""Document fingerprints: quartile bucket digests.

Byte triplets taken from a window of five bytes (six ways to leave two out, the first byte kept) are hashed into
BUCKETS buckets. A digest is 2 hex digits for the length (on a log scale), 2 for the quartiles' ratios, and
two bits per bucket: in which quartile of all buckets its count lies. The difference of two digests adds a length term, the ratio
terms and, per bucket, 0, 1, 2 or 6 for quartiles 0 to 3 apart; it is at most MOST, and likeness is
1 - difference / MOST.

Defined results: null counts as empty; a text of under five bytes has no triplets and all its buckets
in quartile 0, so such texts of equal length class are alike. Equal texts have equal digests. A very long text is counted as a whole. In document order
null ids come first and rows of one id go by a hash of the text, then the text; an empty table gives no rows; the only document is its own next one.
Columns of docs but doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize
from .text import chunks

BUCKETS = 256
#: Positions of a triplet in the window, without the first.
_TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_STEP = np.array([0, 1, 2, 6], np.int64)
_LENGTH_MOST, _RATIO_MOST = 48, 15
MOST = int(_STEP[-1]) * BUCKETS + _LENGTH_MOST + 2 * _RATIO_MOST
_WORK = 1 << 20


def _counts(n: int, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Triplets by text and bucket."""
    out = np.zeros(n * BUCKETS, np.int64)
    size = len(buf) - 4
    if size > 0:
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        same = doc[4:] == doc[:size]
        base = doc[:size][same] * np.int32(BUCKETS)
        b = [buf[i : size + i][same].astype(np.uint32) for i in range(5)]
        for salt, (i, j) in enumerate(_TRIPLETS):
            h = (b[0] + (b[i] << 8) + (b[j] << 16) + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
            h = (h ^ (h >> 15)) * np.uint32(0x85EBCA77)
            out += np.bincount(base + (h >> 24).astype(np.int32), minlength=len(out))
    return out.reshape(n, BUCKETS)


def _digests(n: int, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Digest bytes, a row per text."""
    counts, size = _counts(n, buf, offsets), np.diff(offsets)
    q = np.sort(counts, 1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    level = (counts[:, :, None] > q[:, None, :]).sum(2).astype(np.uint8)
    packed = (level.reshape(n, -1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(2, dtype=np.uint8)
    length = np.minimum(255, np.round(8 * np.log2(size + 1.0))).astype(np.uint8)
    ratio = (q[:, :2] * 15 // np.maximum(q[:, 2:], 1)).astype(np.uint8)
    return np.concatenate([length[:, None], (ratio[:, :1] << 4) | ratio[:, 1:], packed], 1)


def digests(texts: pa.Array) -> np.ndarray:
    parts = [_digests(j - i, buf, offsets) for i, j, buf, offsets in chunks(texts, _WORK)]
    return np.concatenate(parts) if parts else np.zeros((0, 2 + BUCKETS // 4), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the digests in two arrays, row by row: 0 to 1."""
    length = np.minimum(np.abs(a[:, 0].astype(int) - b[:, 0]), _LENGTH_MOST)
    ratios = sum(np.abs((a[:, 1].astype(int) >> s & 15) - (b[:, 1].astype(int) >> s & 15)) for s in (4, 0))
    apart = sum(_STEP[np.abs((a[:, 2:].astype(int) >> s & 3) - (b[:, 2:].astype(int) >> s & 3))].sum(1) for s in (6, 4, 2, 0))
    return 1 - (length + ratios + apart) / MOST


def _hex(d: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in d]


def fingerprint(text: Column) -> Column:
    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(_hex(digests(texts)), pa.string())

    return of(F.coalesce(text, F.lit("")))


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns; null if one is null."""

    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        some = [(bytes.fromhex(u), bytes.fromhex(v)) if u and v else None for u, v in zip(x.to_pylist(), y.to_pylist(), strict=True)]
        got = [p for p in some if p]
        if not got:
            return pa.nulls(len(some), pa.float64())
        values = iter(likeness(*(np.frombuffer(b"".join(p[k] for p in got), np.uint8).reshape(len(got), -1) for k in (0, 1))).tolist())
        return pa.array([next(values) if p else None for p in some], pa.float64())

    return of(a, b)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, __part int, __at int, __text string"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("__part", pa.int32()), ("__at", pa.int32()), ("__text", pa.string())])


def _judged(ids: list, texts: list[str], follow: list[str], own: np.ndarray, after: np.ndarray) -> list[tuple]:
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, follow, strict=True)]
    new = digests(pa.array(edited, pa.large_string()))
    near, nxt, a, b = likeness(own, new), likeness(own, after), _hex(own), _hex(new)
    return [
        (ids[i], len(t), hashlib.sha256(edited[i].encode()).hexdigest(), a[i], b[i], float(near[i]), float(nxt[i]), None, None, None)
        for i, t in enumerate(texts)
    ]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document but a partition's last against the one after it. The first and last leave with their text."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    edge = lambda at, i, t: _record([(i, None, None, None, None, None, None, part, at, t)])
    last = None
    for batch in batches:
        column = batch.column(1).cast(pa.large_string()).fill_null("")
        for i, j, _, _ in chunks(column, 4 * _WORK):
            some = column.slice(i, j - i)
            ids, texts, own = batch.column(0).slice(i, j - i).to_pylist(), some.to_pylist(), digests(some)
            if last is None:
                yield edge(0, ids[0], texts[0])
            else:
                ids, texts, own = [last[0], *ids], [last[1], *texts], np.concatenate([last[2], own])
            if len(ids) > 1:
                yield _record(_judged(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:]))
            last = ids[-1], texts[-1], own[-1:]
    if last:
        yield edge(1, last[0], last[1])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, follow = (batch.column(k).to_pylist() for k in range(3))
        yield _record(_judged(ids, texts, follow, *(digests(pa.array(x, pa.large_string())) for x in (texts, follow))))


def with_next(docs: DataFrame) -> DataFrame:
    """Each document's digest beside those of the next document (by id; after the last the first) and of its text with
    the later half replaced by the next one's start. One shuffle of the texts, by ranges of the id; the partitions' first
    and last documents (two a partition) are paired afterwards."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("__h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "__h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__h", "text")
    held = materialize(ordered.select("doc_id", "text").mapInArrow(_walk, _SCHEMA), "fingerprints")
    edges = held.filter(F.col("__at").isNotNull()).select("doc_id", "__text", "__part", "__at")
    # ranks of the partitions that have rows; as many as there are partitions
    parts = edges.filter("__at = 0").select("__part", (F.row_number().over(Window.orderBy("__part")) - 1).alias("__rank"))
    total = parts.agg(F.count(F.lit(1)).alias("__total"))
    ranked = edges.join(parts, "__part").join(F.broadcast(total))
    lasts = ranked.filter("__at = 1").select("doc_id", "__text", ((F.col("__rank") + 1) % F.col("__total")).alias("__rank"))
    firsts = ranked.filter("__at = 0").select("__rank", F.col("__text").alias("__next"))
    fixed = lasts.join(firsts, "__rank").select("doc_id", "__text", "__next").mapInArrow(_edges, _SCHEMA)
    return held.filter(F.col("__at").isNull()).unionByName(fixed).drop("__part", "__at", "__text")
