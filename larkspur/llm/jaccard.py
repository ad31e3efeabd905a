"""N-gram Jaccard join with signature trees.

Texts become sets of hashed k-word shingles; documents with equal sets share a node. Two nodes link when their sets'
Jaccard similarity is at least num / den.

1. Routing. A set is dealt by hash into parts, as many as two sets that just link may have differences, and a part's
   content becomes a key. Sets that link agree on many parts, others on none, so common words and
   shared passages make no hot key. Sets near the upper end of a size class send keys for the next class, too. About PARTS
   keys a set keep the chance that a linked pair shares none under one in a million at the threshold itself, and far
   lower above it, for thresholds of 0.8 and more (at 0.6 and below small sets are missed more often: they fill too few
   parts); keys of fewer than two shingles are left out, and sets that only an equal set can link with have none. Nodes that share a key get an edge to the
   key's smallest node, within the partition first, and the connected components of these edges are the groups
   within which links can lie.
2. Signature trees. A group's nodes are the leaves of a tree whose inner nodes hold the OR of their bitmaps of hashed
   shingles, their size range and smallest bit count. A dual traversal from the root drops pairs of tree nodes
   whose largest possible overlap is too small, and pairs that lie in one component already. What is left is compared exactly.
3. Groups of over BLOCK nodes are cut into blocks, each joined in a task of its own together with about ANCHORS common
   nodes. The nodes that are not in the group's largest component after that meet all its blocks, where they are up to BLOCK or that takes a node to no more than about MEET
   tasks. Groups with more of them are chains of which few nodes share a key: there, those that share a key are a group each (keys of the same two smallest nodes are one, keys
   within a component go), so that sets still meet if they share any key. Groups by key that are over BLOCK nodes are cut into blocks again.

No pair list of a group is ever written: a tree gives at most one link fewer than it has nodes.

Defined results: null texts and texts without words have no shingles and link with nothing; a text of fewer
than k words has one shingle, its whole sequence; a very long text is shingled as a whole. component_id is null only where all of a component's ids are;
repeated rows are rows each, and copies of each other; rows that share an id but not their text are documents each; an empty table gives no rows. Columns but doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, forest
from .store import discard, materialize
from .text import SPACES, chunks, joined, mix, words

PARTS, BLOCK, BLOCK_SHINGLES, ANCHORS, MEET, FLUSH = 50, 1024, 2_000_000, 8, 8, 1 << 20
#: Rows of a batch given to Spark, which holds it outside its heap.
ROWS = 1 << 16
_ODD = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * _ODD)


def sets_of(buf: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    w = words(buf, offsets, SPACES)
    h = joined(w.hash, k)
    at = np.searchsorted(w.doc, np.arange(len(offsets)))
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            yield np.unique(h[a : b - k + 1])
        else:  # the whole sequence as one, or none
            yield joined(w.hash[a:b], int(b - a)) + np.uint64(b - a) if b > a else h[:0]


def node_of(s: np.ndarray) -> int:
    size = np.array([len(s)], np.uint64)
    return int(mix(mix(s + _ODD).sum(dtype=np.uint64) + size * _ODD).view(np.int64)[0])


def _scheme(j: int, num: int, den: int) -> tuple[int, int]:
    """Parts and rounds for sets of under 2**(j+1) shingles."""
    differ = 2 * (den - num) / (den + num) * 2 ** (j + 1)
    parts = max(2, round(differ / 1.04))
    return parts, min(len(_SEEDS), -(-PARTS // parts))


def keys_of(s: np.ndarray, num: int, den: int) -> np.ndarray:
    n = len(s)
    if n * den < num * (n + 1):  # only an equal set can link: one more shingle is the least difference
        return s[:0]
    j = n.bit_length() - 1
    out = []
    for tag in (j, j + 1) if n * den >= num * 2 ** (j + 1) else (j,):
        parts, rounds = _scheme(tag, num, den)
        x = mix(s[None, :] ^ _SEEDS[:rounds, None]).ravel()
        part = (x >> np.uint64(20)) % np.uint64(parts) + np.repeat(np.arange(rounds, dtype=np.uint64) * np.uint64(parts), n)
        if rounds == 1 and parts > PARTS:
            x, part = x[part < PARTS], part[part < PARTS]
        order = np.argsort(part, kind="stable")
        part, x = part[order], x[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        if not len(first):
            continue
        held = np.diff(np.append(first, len(part))) >= 2
        sums = np.add.reduceat(mix(x + _ODD), first)[held]
        out.append(mix(sums + part[first][held] * _ODD + np.uint64(tag + 1)))
    return np.concatenate(out) if out else s[:0]


_ROUTED = "doc_id long, text_hash long, n long, node long, key long, other long"
_ROUTED_FIELDS = pa.schema([(c.split()[0], pa.int64()) for c in _ROUTED.split(", ")])


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _routed(rows: int, **columns) -> pa.RecordBatch:
    nulls = pa.nulls(rows, pa.int64())
    as_long = lambda x: x if isinstance(x, pa.Array) else pa.array(np.asarray(x, np.int64))
    return pa.record_batch([as_long(columns[f.name]) if f.name in columns else nulls for f in _ROUTED_FIELDS], schema=_ROUTED_FIELDS)


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sorted, distinct (key, node): each key's first node, and edges that connect all the nodes of each key."""
    lead = np.ones(len(key), bool)
    lead[1:] = key[1:] != key[:-1]
    head = node[np.maximum.accumulate(np.where(lead, np.arange(len(key)), 0))]
    a, b = head[~lead], node[~lead]
    pairs = a.view(np.uint64) * _ODD ^ b.view(np.uint64)
    first = np.unique(pairs, return_index=True)[1]  # most pairs share many keys
    return key[lead], node[lead], *forest(a[first], b[first])


def _route(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes whose keys are in hand
        keys, nodes, held = [], [], 0

        def flush():
            if not keys:
                return
            key, node = np.concatenate(keys).view(np.int64), np.concatenate(nodes)
            order = np.lexsort((node, key))
            key, node, a, b = _stars(key[order], node[order])
            order = np.argsort(node, kind="stable")
            key, node = key[order], node[order]
            for i in range(0, len(key), ROWS):
                yield _routed(len(key[i : i + ROWS]), key=key[i : i + ROWS], node=node[i : i + ROWS])
            for i in range(0, len(a), ROWS):
                yield _routed(len(a[i : i + ROWS]), node=a[i : i + ROWS], other=b[i : i + ROWS])

        for batch in batches:
            for i, j, buf, offsets in chunks(batch.column(2)):
                n, ids = [], []
                for s in sets_of(buf, offsets, k):
                    n.append(len(s))
                    ids.append(node_of(s) if len(s) else None)
                    if len(s) and ids[-1] not in seen:
                        seen.add(ids[-1])
                        own = keys_of(s, num, den)
                        keys.append(own)
                        nodes.append(np.full(len(own), ids[-1], np.int64))
                        held += len(own)
                yield _routed(j - i, doc_id=batch.column(0).slice(i, j - i), text_hash=batch.column(1).slice(i, j - i), n=n, node=pa.array(ids, pa.int64()))
                if held >= FLUSH:
                    yield from flush()
                    keys, nodes, held = [], [], 0
                    seen.clear()
        yield from flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) in order: edges that connect the nodes of each key. Of a key that goes on, one node is held."""
    last_key = head = None
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])) if held else _NONE
        held.clear()
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        key, node = (batch.column(i).to_numpy() for i in (0, 1))
        if last_key is not None:
            key, node = np.concatenate([[last_key], key]), np.concatenate([[head], node])
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        if not len(key):
            continue
        _, heads, a, b = _stars(key, node)
        last_key, head = key[-1], heads[-1]
        held.append((a, b))
        if sum(len(x) for x, _ in held) >= FLUSH // 4:  # forest() takes over 250 bytes an edge
            yield flush()
    yield flush()


class _Forest:
    def __init__(self, labels: np.ndarray):
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[inverse]

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def find(self, i: int) -> int:
        while (above := self.up[i]) != i:
            self.up[i] = self.up[above]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    size = int(np.median([len(s) for s in sets])) * 8
    bits = 1 << min(15, max(9, size.bit_length()))
    out = np.zeros((len(sets), bits), bool)
    for row, s in zip(out, sets, strict=True):
        row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def tree_links(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int, fan: int = 8) -> list[tuple[int, int]]:
    """Links that, with those that the labels stand for, connect what all links connect."""
    m = len(sets)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((sizes, [s[0] for s in sets]))  # like sets have like smallest hashes
    sets, sizes, labels = [sets[i] for i in order], sizes[order], labels[order]
    bits = _bitmaps(sets)
    tree = [(bits, sizes, sizes, np.bitwise_count(bits).sum(1).astype(np.int64), labels)]
    while len(tree[-1][0]) > 1:
        ors, low, high, pop, same = tree[-1]
        at = np.arange(0, len(ors), fan)
        first, last = np.minimum.reduceat(same, at), np.maximum.reduceat(same, at)
        tree.append((np.bitwise_or.reduceat(ors, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(pop, at), np.where(first == last, first, -1)))

    def possible(level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs can hold a link between components, and the overlap that they can reach."""
        ors, low, high, pop, same = tree[level]
        keep = (i == j) & (level > 0) | (high[i] * den >= low[j] * num) & (high[j] * den >= low[i] * num)
        keep &= (same[i] != same[j]) | (same[i] < 0)
        i, j = i[keep], j[keep]
        common = np.concatenate([np.bitwise_count(ors[i[a : a + 4096]] & ors[j[a : a + 4096]]).sum(1) for a in range(0, len(i), 4096)] or [np.zeros(0, int)]).astype(np.int64)
        # bits that one side has and the other lacks stand for a shingle each, at least
        most = np.minimum(high[i] - np.maximum(0, pop[i] - common), high[j] - np.maximum(0, pop[j] - common))
        ok = most * (num + den) >= num * (low[i] + low[j])
        at = np.flatnonzero(keep)[ok]
        return at, most[ok]

    i = j = np.zeros(1, np.int64)
    overlap = i
    for level in range(len(tree) - 1, -1, -1):
        at, overlap = possible(level, i, j)
        i, j = i[at], j[at]
        if level:
            n = len(tree[level - 1][0])
            step = np.arange(fan)
            a = (i[:, None, None] * fan + step[None, :, None] + 0 * step[None, None, :]).ravel()
            b = (j[:, None, None] * fan + 0 * step[None, :, None] + step[None, None, :]).ravel()
            ok = (a < n) & (b < n) & ((a <= b) if level > 1 else (a < b))
            i, j = a[ok], b[ok]
    forest, links = _Forest(labels), []
    while len(i):
        root = forest.roots()
        apart = root[i] != root[j]
        i, j, overlap = i[apart], j[apart], overlap[apart]
        if not len(i):
            break
        # the likeliest pair of each two components
        pair = np.minimum(root[i], root[j]) * m + np.maximum(root[i], root[j])
        score = -overlap / np.maximum(sizes[i], sizes[j])
        rank = np.lexsort((score, pair))
        best = rank[np.concatenate([[True], pair[rank][1:] != pair[rank][:-1]])]
        for x in best[np.argsort(score[best], kind="stable")]:
            a, b = int(i[x]), int(j[x])
            if forest.find(a) == forest.find(b):
                continue
            common = len(sets[a]) + len(sets[b]) - len(np.unique(np.concatenate([sets[a], sets[b]])))
            if common * den >= num * (len(sets[a]) + len(sets[b]) - common):
                forest.join(a, b)
                links.append((int(order[a]), int(order[b])))
        left = np.ones(len(i), bool)
        left[best] = False
        i, j, overlap = i[left], j[left], overlap[left]
    return links


def _join_groups(num: int, den: int):
    """One task: the groups (column comp) of a bundle, or a block of one."""

    def run(table: pa.Table) -> pa.Table:
        rows: dict[int, dict[int, tuple]] = {}
        for comp, node, label, s in zip(*(table.column(c).to_pylist() for c in ("comp", "node", "label", "shingles")), strict=True):
            rows.setdefault(comp, {})[node] = (label, s)
        out = []
        for held in rows.values():
            nodes = sorted(held)
            sets = [np.frombuffer(held[x][1], np.uint64) for x in nodes]
            labels = np.unique([held[x][0] for x in nodes], return_inverse=True)[1]
            out += [(nodes[a], nodes[b]) for a, b in tree_links(sets, labels, num, den)]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, comp = batch.column(1).to_numpy(), batch.column(2)
            for i, j, buf, offsets in chunks(batch.column(0)):
                sets = list(sets_of(buf, offsets, k))
                own = [x for x, s in enumerate(sets) if len(s) and node_of(s) == node[i + x]]
                yield pa.record_batch(
                    [comp.take(pa.array([i + x for x in own], pa.int64())), pa.array(node[[i + x for x in own]]), pa.array([len(sets[x]) for x in own], pa.int64()), pa.array([sets[x].tobytes() for x in own], pa.binary())],
                    names=["comp", "node", "n", "shingles"],
                )

    return run


def _keys(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.unique(keys_of(np.frombuffer(s.as_buffer(), np.uint64), num, den)) for s in batch.column(3)]
            node, label, n = (np.repeat(batch.column(c).to_numpy(), [len(x) for x in keys]) for c in (0, 1, 2))
            key = np.concatenate(keys).view(np.int64) if keys else node
            yield pa.record_batch([pa.array(key), pa.array(node), pa.array(label), pa.array(n)], names=["key", "node", "label", "n"])

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, label, n) in order: the nodes of each key with a number, comp, for the key's two smallest nodes; those of several keys with one comp
    once, for FLUSH rows in hand. A key whose nodes have one label goes, unless it goes on in another batch. Of a key that goes on, two rows are held."""
    last, made = np.zeros((0, 4), np.int64), False  # the first rows of the key that the last batch ended in, and whether they are in hand
    held: list[np.ndarray] = []

    def once():
        rows = np.unique(np.concatenate(held), axis=0) if held else last[:0]
        held.clear()
        return rows

    def out(rows):
        return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["comp", "node", "label", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([last, np.stack([c.to_numpy() for c in batch.columns], 1)])
        first = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        many = np.diff(np.append(first, len(rows)))
        keep = np.minimum.reduceat(rows[:, 2], first) < np.maximum.reduceat(rows[:, 2], first)
        keep[0] |= made
        last, made = rows[first[-1] : first[-1] + 2], bool(many[-1] > 1)
        keep[-1] |= made
        one, two = (rows[np.minimum(first + i, len(rows) - 1), 1].view(np.uint64) for i in (0, 1))
        comp = mix(one * _ODD ^ two).view(np.int64)
        rows[:, 0] = np.repeat(comp, many)
        held.append(rows[np.repeat(keep, many)])
        last = np.concatenate([np.full((len(last), 1), batch.column(0)[-1].as_py(), np.int64), last[:, 1:]], 1)
        if sum(map(len, held)) >= FLUSH:
            held.append(once())
            if len(held[0]) >= FLUSH // 2:
                yield out(once())
    yield out(once())


def _sizes(members: DataFrame) -> DataFrame:
    """Of members (comp, n, label): each group's nodes and blocks, the sum of n, and the smallest and largest label."""
    return members.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("total"), F.min("label").alias("low"), F.max("label").alias("high")).withColumn(
        "blocks", F.greatest(F.ceil(F.col("nodes") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    )


def _by_key(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """sets (comp, node, n, label, shingles) in groups, comp, that hold the nodes of every key that nodes of different labels share: a node stands in several. Keys
    with the same two smallest nodes are one group: keys with nearly the same nodes mostly have them in common. Also the groups' sizes."""
    keyed = sets.select("node", "label", "n", "shingles").mapInArrow(_keys(num, den), "key long, node long, label long, n long")
    headed = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_heads, "comp long, node long, label long, n long")
    members = materialize(headed.distinct(), "members")
    sizes = materialize(_sizes(members).filter("low < high"), "group-sizes")
    dealt = members.select("comp", "node").join(sizes.select("comp", "nodes", "blocks"), "comp")
    out = materialize(sets.drop("comp").join(dealt.hint("merge"), "node").select("comp", "node", "n", "label", "shingles", "nodes", "blocks"), "shingles-by-key")
    discard(members)
    return out, sizes


def _links(sets: DataFrame, num: int, den: int, before: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Links a, b that connect what all links connect. sets: comp, node, n, shingles; or by key as _by_key gives them, with the label that the links before
    give, which come back too."""
    if before is None:
        sets = sets.withColumn("label", F.col("node"))
        sizes = materialize(_sizes(sets), "group-sizes")
    whole = sizes.filter("blocks = 1").agg(F.sum("total").alias("t"), F.sum("nodes").alias("n")).first()
    bundles = max(1, -(-(whole["t"] or 0) // (BLOCK_SHINGLES // 2)), -(-(whole["n"] or 0) // BLOCK))
    join = lambda df, *keys: df.groupBy(*keys).applyInArrow(_join_groups(num, den), "a long, b long")
    dealt = sets.join(sizes.select("comp", "blocks", "nodes"), "comp") if before is None else sets
    small = dealt.filter("blocks = 1").withColumn("bundle", F.pmod(F.xxhash64("comp"), F.lit(bundles)))
    big = sizes.filter("blocks > 1")
    if big.isEmpty():
        only = materialize(join(small, "bundle"), "links")
        discard(sizes)
        return only if before is None else before.union(only)
    large = dealt.filter("blocks > 1").withColumn("__h", F.xxhash64("node"))
    block = F.pmod("__h", F.col("blocks")).cast("int")
    anchor = F.pmod(F.xxhash64("node", F.lit(2)), F.col("nodes")) < ANCHORS  # about as many of each group
    spread = large.withColumn("block", F.explode(F.when(anchor, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))))
    first = materialize(join(small, "bundle").union(join(spread, "comp", "block")), "links")
    first = first if before is None else before.union(first)
    found = components(first)
    # nodes outside the largest component of a large group meet all of the group
    now = large.drop("label").join(found.withColumnRenamed("label", "found"), "node", "left").withColumn("label", F.coalesce("found", "node")).drop("found")
    counts = now.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("comp").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")).filter("most < all")
    mains = materialize(main, "mains")
    outside, blocks = (F.ceil(x / BLOCK) for x in (F.col("all") - F.col("most"), F.col("all")))
    many = (outside > 1) & (outside + blocks > MEET)  # all of these with all blocks would be the square of the group
    if mains.isEmpty():
        discard(sizes, found, mains)
        return first
    chains = mains.filter(many) if before is None else mains.limit(0)
    main = mains.filter(~many) if before is None else mains
    rest = now.join(main, "comp").withColumn("outside", F.col("label") != F.col("main")).withColumn("parts", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    every = F.pmod("__h", F.col("blocks")).cast("int")
    # task (p, q): block q of the group with part p of those outside
    tasks = rest.select(
        "comp", "node", "label", "shingles",
        F.explode(F.array_union(
            F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("p"), every.alias("q"))),
            F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda q: F.struct(mine.alias("p"), q.alias("q")))).otherwise(F.array().cast("array<struct<p:int,q:int>>")),
        )).alias("task"),
    )
    more = materialize(join(tasks.select("comp", "node", "label", "shingles", "task.p", "task.q"), "comp", "p", "q"), "links")
    links = first.union(more)
    if not chains.isEmpty():
        keyed, keyed_sizes = _by_key(now.join(chains.select("comp"), "comp").select("comp", "node", "n", "label", "shingles"), num, den)
        links = _links(keyed, num, den, links, keyed_sizes)
        discard(keyed)
    discard(sizes, found, mains)
    return links


def components_of(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row per row of docs: doc_id, text_hash (see text_hash()), n_shingles, component (a number for each component; null where there
    are no words), component_id (the smallest doc_id that links reach)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    routed = materialize(rows.mapInArrow(_route(k, num, den), _ROUTED), "routed")
    keyed = routed.filter("key IS NOT NULL").select("key", "node")
    met = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meet, "a long, b long")
    edges = routed.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")).union(met)
    groups = components(edges)
    members = routed.filter("key IS NULL AND other IS NULL AND node IS NOT NULL").select("doc_id", "text_hash", "n", "node")
    # a node's text is that of one (id, text); no row is met by id alone, so rows that repeat an id meet nothing of each other
    row = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("h"))
    firsts = members.groupBy("node").agg(F.min(row).alias("row"), F.min("doc_id").alias("first"))
    wanted = materialize(groups.select("node", F.col("label").alias("comp")).join(firsts, "node").select("row.id", "row.h", "node", "comp"), "wanted")
    # equal rows are one before they are shuffled; wanted grows with the corpus: one plan at all sizes, though a small one could be broadcast
    texts = rows.groupBy(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("h")).agg(F.first("text").alias("text"))
    sets = materialize(texts.join(wanted.hint("merge"), ["id", "h"]).select("text", "node", "comp").mapInArrow(_sets(k), "comp long, node long, n long, shingles binary"), "shingles")
    links = _links(sets, num, den)
    discard(sets, wanted)
    labels = components(links)
    nodes = firsts.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("component"))
    smallest = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = nodes.select("node", "component").join(smallest, "component").select("node", "component", "component_id")
    every = routed.filter("key IS NULL AND other IS NULL").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node")
    linked = every.filter("node IS NOT NULL").join(named, "node").select("doc_id", "text_hash", "n_shingles", "component", "component_id")
    alone = every.filter("node IS NULL").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    return components_of(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: that of the smallest id (null after all others), then of the smallest text hash; of rows that
    repeat this id and text, one. Rows without words all stay."""
    key = ["__one_null", "__one_id", "__one_hash"]
    if set(docs.columns) & set(key):
        raise ValueError(f"columns {key} are taken")
    of = lambda id_, hash_: dict(zip(key, (id_.isNull(), F.coalesce(id_, F.lit(0)), hash_), strict=True))
    found = components_of(docs, k, num, den).filter("component IS NOT NULL")
    found = found.select("component", *[c.alias(n) for n, c in of(F.col("doc_id"), F.col("text_hash")).items()])
    rows = found.groupBy("component", *key).agg(F.count(F.lit(1)).alias("rows"))
    firsts = rows.groupBy("component").agg(F.min(F.struct(*key)).alias("best"))
    gone = materialize(rows.join(firsts, "component").filter(F.struct(*key) != F.col("best")).select(*key), "gone")
    keyed = docs.withColumns(of(F.col("doc_id").cast("long"), text_hash(F.col("text"))))
    words = F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")) != ""
    # rows that repeat an id and text are one before they are shuffled; the same plan at all sizes, though a small table could be broadcast
    # (an anti join would be moved before the step that makes them one)
    each = keyed.filter(words).dropDuplicates(key).join(gone.withColumn("__one_gone", F.lit(True)).hint("merge"), key, "left").filter("__one_gone IS NULL")
    return each.select(*docs.columns).unionByName(keyed.filter(~words).select(*docs.columns))
