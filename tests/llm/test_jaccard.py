import random
import re

import numpy as np
import pytest

from larkspur.llm import jaccard
from larkspur.llm.graph import components

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(s), best.get(find(i), -1)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def run(frame, rows, k=4, num=85, den=100):
    got = jaccard.join(frame(rows, "doc_id long, text string").repartition(4), k, num, den).collect()
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(90)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4:  # copies of a base with some edits
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = word()
        elif kind < 0.6:
            t = [word() for _ in range(rng.randint(1, 80))] + passage
        elif kind < 0.8 and rows:
            t = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = word()
        else:
            t = [word() for _ in range(rng.randint(1, 300))]
        rows.append((i * 3 % 1009, " ".join(t)))
    return rows


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_against_brute_force(frame, seed, k, num):
    rows = corpus(seed)
    assert run(frame, rows, k, num) == brute(rows, k, num, 100)


@pytest.mark.parametrize(("k", "num", "words"), [(4, 85, 9), (5, 80, 8)])
def test_smallest_sets_that_link(frame, k, num, words):
    rows = []
    for i in range(40):  # a text and the same with one word added at either end, and one too short to link with more than copies
        t = [f"w{i}x{j}" for j in range(words)]
        rows += [(4 * i + 3, " ".join(t)), (4 * i + i % 2, " ".join([*t, "more"])), (4 * i + 1 - i % 2, " ".join(["more", *t])), (4 * i + 2, " ".join(t[1:-1]))]
    want = brute(rows, k, num, 100)
    assert sum(d != c for d, _, c in want) == 80
    assert run(frame, rows, k, num) == want


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_every_size_up_to_forty_against_brute_force(frame, k, num):
    """Pairs at the threshold: a set and the smallest it can lose (a subset), and one with as many shingles swapped as still link, and one more."""
    rows, rng = [], random.Random(num)
    for n in range(1, 41):
        for trial in range(4):
            w = [f"n{n}t{trial}w{j}" for j in range(n + k - 1)]
            texts = [w]
            lost = max((d for d in range(n) if 100 * (n - d) >= num * n), default=0)
            texts.append(w[: len(w) - lost])  # the smallest subset that links
            texts.append(w[: len(w) - lost - 1])  # one shingle less does not, with the first
            more = max(d for d in range(n + 1) if 100 * n >= num * (n + d))
            texts.append([*w, *[f"m{n}t{trial}w{j}" for j in range(more)]])
            at = rng.randrange(len(w))
            texts.append([*w[:at], "swap", *w[at + 1 :]])  # up to k shingles swapped
            texts.append([*w[:-1], "swap"])  # one swapped
            for t in texts:
                rows.append((len(rows) * 7 % 100_003, " ".join(t)))
    assert run(frame, rows, k, num) == brute(rows, k, num, 100)


def test_rows_that_share_an_id_meet_by_their_texts(frame):
    rows = [(1, "one two three four five six"), (1, "q r s t u v w"), (2, "one two three four five six"), (3, "q r s t u v w"), (3, "q r s t u v w")] + [(9, f"text number {i} of this very id") for i in range(300)]
    assert run(frame, rows) == brute(rows, 4, 85, 100)


def test_one_of_each_component_stays(frame):
    text = "a b c d e f g h"
    rows = [(5, text), (3, text + " i"), (3, text + " i"), (3, "other words that are alone here"), (None, text), (None, "no id but a text of its own"), (8, None), (8, ""), (8, None), (7, "Other  words that\nare alone here"), (4, "z"), (4, "z"), (6, "y " * 60_000)]
    got = jaccard.one_of_each(frame(rows, "doc_id long, text string"))
    assert got.columns[:2] == ["doc_id", "text"] and {"score", "key", "node", "label", "n"} <= set(got.columns)
    want = [(3, text + " i"), (3, "other words that are alone here"), (None, "no id but a text of its own"), (8, None), (8, ""), (8, None), (4, "z"), (6, "y " * 60_000)]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((str(a), str(b)) for a, b in want)
    assert jaccard.one_of_each(frame([], "doc_id long, text string")).collect() == []


def test_large_groups_are_cut_into_blocks(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = corpus(7, 120)
    assert run(frame, rows) == brute(rows, 4, 85, 100)


def test_edges(frame):
    rows = [(1, "a b c d e"), (2, "A b\tC d\ne"), (3, "a b"), (4, "A  B"), (5, ""), (6, None), (7, " \n"), (8, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "q"), (9, "long " * 50_000), (10, "b a")]
    assert run(frame, rows) == brute(rows, 4, 85, 100)
    assert run(frame, []) == []


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.06, 0.3]), rng.integers(0, 2**63, 60).astype(np.uint64), base)) for _ in range(40)]
        labels = rng.integers(0, 30, 40)
        forest, want = jaccard._Forest(labels), jaccard._Forest(labels)
        for a, b in jaccard.tree_links(sets, labels, 85, 100):
            assert forest.join(a, b)
        for a in range(40):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    want.join(a, b)
        assert (forest.roots() == want.roots()).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30, 60)] + [(7, 7), (3, 2)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([*range(80, 110)], 80)}


@pytest.mark.parametrize("size", [600, 1200])
def test_chained_families_cost_their_own_size(spark, monkeypatch, size):
    """A group of many families that only chains hold together: the rows that the trees get grow with the nodes, not with their square."""
    rng = np.random.default_rng(5)
    sets, family = [], []
    for i in range(size // 4):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        for j in range(4):  # copies with ever more shingles swapped: some link
            own = base.copy()
            own[: (0, 3, 12, 30)[j]] = rng.integers(0, 1 << 63, (0, 3, 12, 30)[j], dtype=np.uint64)
            sets.append(np.unique(own))
            family.append(i)
    node = {jaccard.node_of(s): (i, s) for i, s in zip(family, sets, strict=True)}
    given = spark.createDataFrame([(1, x, len(s), s.tobytes()) for x, (_, s) in node.items()], "comp long, node long, n long, shingles binary")
    met, plain = spark.sparkContext.accumulator(0), jaccard._join_groups

    def counted(num, den):
        run = plain(num, den)

        def count(table):
            met.add(table.num_rows)
            return run(table)

        return count

    monkeypatch.setattr(jaccard, "BLOCK", 32)
    monkeypatch.setattr(jaccard, "_join_groups", counted)
    label = {r["node"]: r["label"] for r in components(jaccard._links(given.repartition(4), 85, 100)).collect()}
    for x, (i, s) in node.items():
        for y, (j, t) in node.items():
            if x < y and i == j:
                common = len(np.intersect1d(s, t))
                if common * 100 >= 85 * (len(s) + len(t) - common):
                    assert label[x] == label[y]
    assert all(node[x][0] == node[y][0] for x, y in label.items())
    assert met.value <= 12 * size  # cut into blocks at random: a node goes to size / 32 tasks and more


@pytest.mark.parametrize("few", [0, 25])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, few):
    monkeypatch.setattr("larkspur.llm.graph.FEW", few, raising=False)
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30, 60)] + [(7, 7), (3, 2), (100, 50 + 30)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([*range(80, 110)], 80)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_edges_take_no_rounds(spark, monkeypatch):
    from larkspur.llm import graph

    written, plain = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or plain(df, name))
    got = dict(components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long").repartition(8)).collect())
    assert got == dict.fromkeys(range(201), 0)
    assert written == ["edges", "hooks"]  # each round writes three tables


def test_nodes_that_share_many_keys_stand_in_few_groups(spark, monkeypatch):
    """A family whose members share most of their keys and hardly link: by key, each would be dealt once for each key that it shares."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 140, dtype=np.uint64)
    sets = {}
    for i in range(400):
        own = rng.integers(0, 1 << 63, 140, dtype=np.uint64)
        at = rng.permutation(140)[: 8 if i % 4 else 14]  # two that have 8 of 140 swapped link at 85; two with 14 at times do not
        s = np.unique(np.where(np.isin(np.arange(140), at), own, base))
        sets[jaccard.node_of(s)] = s
    given = spark.createDataFrame([(1, x, len(s), s.tobytes(), x) for x, s in sets.items()], "comp long, node long, n long, shingles binary, label long")
    made, plain = {}, jaccard.materialize

    def counted(df, name):
        out = plain(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    found = jaccard._by_key(given.repartition(4), 85, 100)
    rows = (found[0] if isinstance(found, tuple) else found).select("comp", "node").collect()
    assert made["shingles-by-key"] == [len(rows)] and len(rows) <= 25 * len(sets)
    groups = {}
    for comp, node in rows:
        groups.setdefault(node, set()).add(comp)
    keys = {x: set(jaccard.keys_of(s, 85, 100).tolist()) for x, s in sets.items()}
    nodes = list(sets)
    assert all(groups[x] & groups[y] for i, x in enumerate(nodes) for y in nodes[:i] if keys[x] & keys[y])


def test_keys_that_go_on_in_another_batch_keep_their_nodes():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    label = rng.integers(0, 3, 30)
    nodes_of = {key: np.sort(rng.permutation(30)[: rng.integers(1, 14)]) for key in range(200)}
    rows = np.array([(key, node, label[node], 5) for key, nodes in nodes_of.items() for node in nodes], np.int64)
    for size in (1, 2, 7, 100, len(rows)):
        batches = [pa.record_batch([pa.array(c) for c in rows[a : a + size].T], names=["key", "node", "label", "n"]) for a in range(0, len(rows), size)]
        groups = {}
        for batch in jaccard._heads(iter(batches)):
            for row in batch.to_pylist():
                assert row["label"] == label[row["node"]] and row["n"] == 5
                groups.setdefault(row["comp"], set()).add(row["node"])
        for nodes in nodes_of.values():
            if len(set(label[nodes])) > 1:
                assert any(group >= set(nodes.tolist()) for group in groups.values())
        allowed = {tuple(nodes[:2]): set() for nodes in nodes_of.values() if len(nodes) > 1}
        for nodes in nodes_of.values():
            if len(nodes) > 1:
                allowed[tuple(nodes[:2])] |= set(nodes.tolist())
        assert len(groups) <= len(allowed) and all(any(group <= whole for whole in allowed.values()) for group in groups.values())
