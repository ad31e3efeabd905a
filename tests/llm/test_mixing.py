import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def rows_of(sizes):
    rows, i = [], 0
    for source, (docs, words) in sizes.items():
        for _ in range(docs):
            rows.append((i, "w " * words + "é", source))
            i += 1
    return rows


def test_weights_quotas_and_repeats(frame):
    rows = rows_of({"hot": (600, 20), "mid": (100, 30), "tail": (20, 10), None: (15, 10)})
    mixed = mixing.mix(frame(rows, SCHEMA), evenness=0.9, repeats=4.0).collect()
    tokens = {i: len(t.split()) for i, t, _ in rows}
    total = sum(tokens.values())
    got, weight = Counter(), {}
    for r in mixed:
        got[r["source"]] += tokens[r["doc_id"]]
        weight[r["source"]] = r["mix_weight"]
    assert abs(sum(weight.values()) - 1) < 1e-9
    # each source has its quota, to within a document
    for s, w in weight.items():
        assert w * total - 40 <= got[s] <= w * total + 1
    entropy = -sum(w * math.log(w) for w in weight.values())
    share = Counter()
    for i, _, s in rows:
        share[s] += tokens[i]
    repeats = max(w * total / share[s] for s, w in weight.items())
    assert repeats <= 4.0 + 1e-6
    assert entropy >= 0.9 * math.log(4) - 1e-6 or abs(repeats - 4.0) < 1e-3
    # an epoch takes no document twice, and starts only when the one before it is used up
    assert max(Counter((r["doc_id"], r["mix_epoch"]) for r in mixed).values()) == 1
    times = Counter(r["doc_id"] for r in mixed)
    for s in weight:
        own = [times[i] for i, _, x in rows if x == s]
        assert max(own) - min(own) <= 1


def test_no_constraint_keeps_equal_weights_or_shares(frame):
    rows = rows_of({"a": (50, 9), "b": (10, 9)})
    weight = {r["source"]: r["mix_weight"] for r in mixing.mix(frame(rows, SCHEMA), evenness=None, repeats=1.0).collect()}
    assert abs(weight["a"] - 5 / 6) < 1e-3
    weight = {r["source"]: r["mix_weight"] for r in mixing.mix(frame(rows, SCHEMA), evenness=1.0, repeats=None).collect()}
    assert abs(weight["a"] - 0.5) < 1e-6


def test_edges(frame):
    assert mixing.mix(frame([], SCHEMA)).collect() == []
    assert mixing.mix(frame([(1, None, "a"), (2, "", None)], SCHEMA)).collect() == []
    rows = [(1, "one two", "a"), (1, "one two", "a"), (None, "three", "a"), (4, None, "a")]
    mixed = mixing.mix(frame(rows, SCHEMA))
    assert "source" in mixed.columns and mixed.columns.count("mix_block") == 1
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in mixed.collect()) == [(0, "three"), (1, "one two"), (1, "one two"), (4, "")]


def test_token_count(spark):
    df = spark.createDataFrame([(" a  b\n\tc ", 3), ("", 0), (None, 0), ("   ", 0), ("x", 1), ("a\x0bb", 2)], "t string, n int")
    assert all(r[0] == r[1] for r in df.select(mixing.token_count(df["t"]), "n").collect())


def test_even_sources_keep_every_document_once(frame):
    rows = [(i, "w " * (20 + i * i % 9), f"s{i}") for i in range(200)] + [(1000 + i, "", f"s{i}") for i in range(200)]
    got = mixing.mix(frame(rows, "doc_id long, text string, source string")).select("doc_id", "mix_epoch").collect()
    assert sorted((r["doc_id"], r["mix_epoch"]) for r in got) == sorted((d, 0) for d, _, _ in rows)


@pytest.mark.parametrize("bins", [8, 1 << 12])
def test_against_brute_force(frame, monkeypatch, bins):
    """Whole epochs, then every document before the first that the rest of the quota has no room for."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 64)
    monkeypatch.setattr(mixing, "BINS", bins)
    rows = [(i if i % 11 else None, "w " * (i * i % 23), f"s{min(i % 7, i % 3)}" if i % 13 else None) for i in range(400)] + [(1000, "same row again", "s0")] * 30
    docs = frame(rows, SCHEMA).repartition(5)
    got = mixing.mix(docs, evenness=0.97, repeats=3.0, budget=5000).collect()
    weight = {r["source"]: r["mix_weight"] for r in got}
    own = defaultdict(list)
    for d, t, s in rows:
        own[s].append((d, t))
    bits = {s: math.ceil(math.log2(max(1, sum(len(t.split()) for _, t in x) / 64))) for s, x in own.items()}
    hashed = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("h")).collect()
    for s, w in weight.items():
        tokens = sum(len(t.split()) for _, t in own[s])
        epochs, rest = divmod(round(w * 5000), tokens)
        want = Counter({(d, t): epochs * n for (d, t), n in Counter(own[s]).items()})
        one = docs.sparkSession.createDataFrame([(r["h"], r["doc_id"], r["text"]) for r in hashed if r["source"] == s], "h long, doc_id long, text string")
        place = mixing.place_of(F.col("h"), F.lit(bits[s]), F.lit(epochs).cast("long"))
        last = sorted((r[0], r[1] or -1, r[2], r[1]) for r in one.select(place, "doc_id", "text").collect())
        assert all(0 <= r[0] < 2**63 for r in last)
        upto, cut = 0, None
        for p, _, t, _ in last:
            upto += len(t.split())
            if upto > rest:
                cut = p
                break
        for p, _, t, d in last:
            if rest and p < cut:
                want[d, t] += 1
        assert Counter((r["doc_id"], r["text"]) for r in got if r["source"] == s) == +want
        assert all(0 <= r["mix_at"] <= 1 and 0 <= r["mix_block"] < 1 << bits[s] for r in got if r["source"] == s)


def test_blocks_are_permuted(spark):
    rows = spark.range(64).select(mixing.place_of(F.col("id"), F.lit(6), F.lit(3).cast("long")).alias("p")).collect()
    assert sorted(r["p"] >> 57 for r in rows) == list(range(64)) and [r["p"] >> 57 for r in rows] != list(range(64))


@pytest.mark.parametrize(("evenness", "repeats"), [(None, 1.0), (0.5, 1.0), (None, 1.0000001)])
def test_a_mix_at_the_sources_own_shares_returns_every_row(frame, evenness, repeats):
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 5 * (i % 3)}") for i in range(400)]
    got = mixing.mix(frame(rows, SCHEMA), evenness, repeats).collect()
    assert sorted((r["doc_id"], r["mix_epoch"]) for r in got) == [(i, 0) for i in range(400)]
