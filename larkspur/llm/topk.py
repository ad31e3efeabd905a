"""Exact top-k inner-product search by distributed histogram selection.

The queries are written once, then meet all vectors in blocks of at most `block` queries, whose matrix is
broadcast (block * dimension * 8 bytes, checked against BLOCK_BYTES). A task goes through a block TILE queries at a time. For each block:

1. every partition scores its vectors and sends, per query, a histogram of the scores over equal bins
   of the query's open range; only the bins down to the partition's own kth score go out, since the
   global kth score is not below a partition's kth;
2. the summed histograms give the bin that holds the global kth score, which becomes the open range;
   repeated until the bins are single scores, which takes log(range) / log(BINS) rounds;
3. what scores above the kth value comes out; of the ties at it each partition sends only as many of
   the smallest ids as are still wanted, and the smallest of these win.

The driver holds two numbers per query of the block at hand, never candidates.

Scores are 64-bit whole numbers; where the product of two vectors' lengths reaches 2**62 they might not be, and the search raises OverflowError.

Defined results: vectors that are null or have null or non-finite components, and null ids, take no
part. Long vectors make smaller blocks. Columns but the id and the vector are not read. Vectors of another length than the query's have no score with it. Rows with the query's own id are no
candidates; an id in several rows queries with the smallest vector of them, and each row is a
candidate to others. Fewer than k candidates: all. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialize

BINS, BLOCK, BLOCK_BYTES, TILE = 512, 32_768, 64 << 20, 2048
_EXACT, _MOST = 2.0**52, 2.0**62


def _matrices(batch: pa.RecordBatch, rows: int = 4096):
    """(length, ids, matrix) for the batch's vectors, grouped by their length; int64 components."""
    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    offsets, flat = np.asarray(vectors.offsets), np.asarray(vectors.values)
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), rows):
            some = at[i : i + rows]
            yield int(n), ids[some], flat[offsets[some][:, None] + np.arange(n)]


def _scores(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Candidates by queries; through float64 where every partial sum fits its mantissa."""
    return (c.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64) if exact else c @ q.T


def _tiles(n: int) -> Iterator[slice]:
    return (slice(i, min(i + TILE, n)) for i in range(0, n, TILE))


def _histograms(block, k: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, lo, width = block.value
        counts = np.zeros((len(qid), BINS + 1), np.int32)  # the last bin: above the open range
        for batch in batches:
            for n, ids, c in _matrices(batch):
                if n != q.shape[1]:
                    continue
                for t in _tiles(len(qid)):
                    bins = np.clip((_scores(q[t], c, exact) - lo[t]) // width[t], -1, BINS)
                    bins[ids[:, None] == qid[t]] = -1
                    flat = (bins + np.arange(bins.shape[1]) * (BINS + 1))[bins >= 0]
                    counts[t] += np.bincount(flat, minlength=bins.shape[1] * (BINS + 1)).reshape(-1, BINS + 1).astype(np.int32)
        for t in _tiles(len(qid)):
            some = counts[t].astype(np.int64)
            above = np.cumsum(some[:, ::-1], 1)[:, ::-1] - some  # in higher bins
            i, j = np.nonzero((some > 0) & (above < k))
            yield pa.record_batch([pa.array((i + t.start).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(some[i, j])], names=["q", "bin", "n"])

    return run


def _winners(block, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, kth, ties = block.value
        held: dict[int, np.ndarray] = {}  # by query: the smallest ids that tie, at most as many as are wanted

        def out(i, ids, scores):
            return pa.record_batch([pa.array(qid[i]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for n, ids, c in _matrices(batch):
                if n != q.shape[1]:
                    continue
                for t in _tiles(len(qid)):
                    s = _scores(q[t], c, exact)
                    own = ids[:, None] == qid[t]
                    j, i = np.nonzero((s > kth[t]) & ~own)
                    yield out(i + t.start, ids[j], s[j, i])
                    tied = (s == kth[t]) & ~own
                    for i in np.flatnonzero(tied.any(0)):
                        if ties[at := i + t.start]:
                            held[at] = np.sort(np.concatenate([held.get(at, ids[:0]), ids[tied[:, i]]]))[: ties[at]]
        for i, some in held.items():
            yield out(np.full(len(some), i), some, np.full(len(some), kth[i]))

    return run


def clean(df: DataFrame, id_col: str, vector: Column) -> DataFrame:
    """__id, __v: the vectors that take part; vector is an array of long whose components may be null."""
    ok = F.col(id_col).isNotNull() & vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    return df.filter(ok).select(F.col(id_col).cast("long").alias("__id"), vector.alias("__v"))


def top_k(vectors: DataFrame, is_query: Column, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. vectors: __id long, __v array<long> (see clean)."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    found = stored = None
    size = F.size("__v")
    norm = F.aggregate("__v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    queries = materialize(vectors.filter(is_query).groupBy("__id").agg(F.min("__v").alias("__v")), "topk-queries")
    lengths = [r for r in vectors.groupBy(size.alias("n")).agg(F.max(norm).alias("norm")).collect()]
    for row in lengths:
        n, largest = row["n"], float(row["norm"] or 0) ** 0.5
        same = vectors.filter(size == n)
        rows = min(block, max(1, BLOCK_BYTES // (8 * max(n, 1))))
        after = None
        while True:
            at = queries.filter(size == n) if after is None else queries.filter((size == n) & (F.col("__id") > after))
            part = at.orderBy("__id").limit(rows).toArrow()  # one block, by key: bounded by rows
            if not part.num_rows:
                break
            qid = part.column("__id").to_numpy()
            flat = part.column("__v").combine_chunks()
            q = np.asarray(flat.flatten(), np.int64).reshape(len(qid), n)
            after = int(qid[-1])
            one = _select(spark, same, qid, q, k, largest, schema)
            if found is None:
                found = one
            else:  # several blocks: each is written, so that the plan stays small
                if stored is None:
                    stored = materialize(found, "topk").stored_at
                one.write.mode("append").parquet(stored)
            if part.num_rows < rows:
                break
    discard(queries)
    if stored:
        found = spark.read.schema(schema).parquet(stored)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _select(spark, vectors: DataFrame, qid, q, k: int, largest: float, schema: str) -> DataFrame:
    sc = spark.sparkContext
    bound = np.ceil(np.sqrt((q.astype(np.float64) ** 2).sum(1)) * largest) + 1  # Cauchy and Schwarz
    if (bound >= _MOST).any():  # partial sums are bounded by the same product
        raise OverflowError("scores may leave 64 bits: the vectors are too long")
    exact = bool((bound < _EXACT).all())
    top = bound.astype(np.int64)
    lo, hi = -top, top + 1  # the kth score lies in [lo, hi)
    above = np.zeros(len(qid), np.int64)  # scores of at least hi
    short = np.zeros(len(qid), bool)  # fewer than k candidates: all of them come out
    while True:
        width = np.maximum(1, -(-(hi - lo) // BINS))
        block = sc.broadcast((qid, q, lo, width))
        counts = vectors.mapInArrow(_histograms(block, k, exact), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # one row a query: the bin that holds its kth score, or its lowest
        seen = counts.withColumn("upto", F.sum("n").over(down))
        cut = seen.groupBy("q").agg(
            F.max(F.when(F.col("upto") >= k, F.col("bin"))).alias("bin"),
            F.max_by(F.col("upto") - F.col("n"), F.when(F.col("upto") >= k, F.col("bin"))).alias("before"),
        ).toArrow()
        block.unpersist()
        at, bins = cut.column("q").to_numpy(), cut.column("bin").to_numpy(zero_copy_only=False)
        hit = ~np.isnan(bins.astype(float))
        i = at[hit]
        short[np.setdiff1d(np.arange(len(qid)), i)] = True
        above[i] = cut.column("before").to_numpy(zero_copy_only=False)[hit].astype(np.int64)
        b = bins[hit].astype(np.int64)
        lo[i] = lo[i] + b * width[i]
        hi[i] = lo[i] + width[i]
        if ((hi - lo)[~short] <= 1).all():
            break
    kth = np.where(short, np.iinfo(np.int64).min, lo)
    ties = np.where(short, 0, k - above)
    return vectors.mapInArrow(_winners(sc.broadcast((qid, q, kth, ties)), exact), schema)
