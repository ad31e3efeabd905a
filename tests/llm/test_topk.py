import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import topk


def brute(rows, is_query, k):
    out = []
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and is_query(i):
            seen[i] = min(seen.get(i, v), v)
    for q, v in seen.items():
        scores = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), i) for i, c in rows if i is not None and c is not None and None not in c and i != q and len(c) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(frame, rows, k=5, block=4096):
    df = frame(rows, "vec_id long, e array<long>").repartition(3)
    found = topk.top_k(topk.clean(df, "vec_id", F.col("e")), F.col("__id") % 5 == 0, k, block)
    return sorted(tuple(r) for r in found.collect())


def test_against_brute_force(frame):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-50, 50, 8).tolist()) for i in range(200)]
    assert run(frame, rows) == brute(rows, lambda i: i % 5 == 0, 5)
    assert run(frame, rows, block=7) == brute(rows, lambda i: i % 5 == 0, 5)


def test_ties_go_to_the_smaller_id_also_in_a_hot_group(frame):
    rows = [(i, [1, 2] if i % 3 else [3, 1]) for i in range(90)] + [(1000, None), (None, [1, 2]), (1005, [1, None]), (1010, [1, 2, 3]), (7, [9, 9])]
    assert run(frame, rows) == brute(rows, lambda i: i % 5 == 0, 5)


def test_few_candidates_and_large_values(frame):
    rows = [(0, [2**30, 2**30]), (5, [2**30 - 1, 2**30]), (6, [-(2**30), 1])]
    assert run(frame, rows) == brute(rows, lambda i: i % 5 == 0, 5)
    assert run(frame, [(0, [1])]) == []
    assert run(frame, []) == []


def test_scores_that_may_leave_64_bits_are_an_error(frame):
    with pytest.raises(OverflowError):
        run(frame, [(0, [2**40, 2**40]), (5, [2**40, 1]), (6, [2, 0])])


def test_tiles(frame, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 4).tolist()) for i in range(120)]
    assert run(frame, rows) == brute(rows, lambda i: i % 5 == 0, 5)
    assert run(frame, rows, block=10) == brute(rows, lambda i: i % 5 == 0, 5)
