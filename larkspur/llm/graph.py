"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize

#: As many edges as one task finishes by itself.
FEW = 1 << 14


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each node to the smallest node of its component, for edges in hand."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        root = i
        while (p := up.get(root, root)) != root:
            root = p
        while i != root:
            up[i], i = root, up.get(i, root)
        return root

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        up[max(x, y)] = up[min(x, y)] = min(x, y)
    found = [(find(i), i) for i in up if find(i) != i]
    out = np.array(found, np.int64).reshape(len(found), 2)
    return out[:, 0], out[:, 1]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All the edges that are left: node, label of their components."""
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    root, node = forest(*(np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in (0, 1)))
    tops = np.unique(root)
    yield pa.record_batch([pa.array(np.concatenate([x, tops])) for x in (node, root)], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long. node, label: the smallest node of its component; nodes without edges are absent.

    Each round every node hooks onto its smallest neighbour, and onto that one's; then edges are redrawn between what their
    ends hooked onto, and those within one are dropped. Edges shrink from round to round, whose number grows with the logarithm
    of the components' width. Every round's tables are written; a hub's rows are pre-aggregated or left to the skew join. The last FEW
    edges are finished by one task."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(edges.filter("a <> b").select(low.alias("a"), high.alias("b")).distinct(), "edges")
    hooks: list[DataFrame] = []
    while now.count() > FEW:
        both = now.union(now.select("b", "a"))
        up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")), "up")
        above = up.select(F.col("node").alias("up"), F.col("up").alias("label"))
        hook = materialize(up.join(above, "up").select("node", "label"), "hooks")
        a, b = (hook.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        redrawn = now.join(a, "a").join(b, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        old, now = now, materialize(redrawn, "edges")
        discard(old, up)
        hooks.append(hook)
    hooks.append(materialize(now.coalesce(1).mapInArrow(_finish, "node long, label long"), "hooks"))
    labels = hooks[0]
    for hook in hooks[1:]:
        after = hook.select(F.col("node").alias("label"), F.col("label").alias("__after"))
        labels = labels.join(after, "label", "left").select("node", F.coalesce("__after", "label").alias("label"))
    if len(hooks) > 1:
        labels = materialize(labels, "labels")
        discard(*hooks)
    discard(now)
    return labels
