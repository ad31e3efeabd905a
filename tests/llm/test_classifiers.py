import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import quality, toxicity
from larkspur.llm.queries import op4_toxicity, op10_quality
from larkspur.llm.text import SPACES, chunks, words

DIR = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("query", "label", "least"), [(op4_toxicity, "toxic", 0.95), (op10_quality, "quality", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    rows = query(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id")
    held = rows.filter("held_out").select(F.avg((F.col("predicted") == F.col(label)).cast("double")), F.min("score"), F.max("score"), F.sum(label), F.sum(F.col(label) * F.col("predicted"))).first()
    assert held[0] >= least and 0 <= held[1] <= held[2] <= 1
    assert held[4] >= 0.8 * held[3]


def test_pairs_count_more_than_their_terms():
    """Two words that are harmless alone."""
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        texts.append(" ".join(rng.permutation([f"w{x}" for x in rng.integers(0, 300, 6)] + ["insult"] * a + ["group"] * b)))
        labels.append(float(a and b))
    rows = []
    for _, j, buf, offsets in chunks(pa.array(texts), 1 << 30):
        doc, bucket = toxicity.terms(buf, offsets)
        rows = [np.unique(bucket[doc == i]).astype(np.int32) for i in range(j)]
    m = toxicity.fit(np.array(labels), rows)

    def score(t):
        (_, j, buf, offsets), = chunks(pa.array([t]))
        return m.score(j, *toxicity.terms(buf, offsets))[0]

    assert score("w1 insult w2 w9 group w3") > 0.8 > 0.3 > max(score("w1 insult w2 w9"), score("w5 group w3 w8"), score(""))


def test_shapes_and_interactions_of_the_additive_model():
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(quality.FEATURES)))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)).astype(float)
    m = quality.fit(y, x)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95
    assert {(i, j) for i, j, _ in m.pairs} >= {(1, 0)}


def test_text_edges_and_labels(frame, spark):
    docs = frame([(1, "good text here"), (2, None), (3, ""), (None, "no id"), (1, "good text here"), (5, "x " * 200_000)], "doc_id long, text string")
    for labels in ([], [(1, 1, 1), (2, 0, 0), (3, None, None), (3, 1, 1), (5, 0, 1), (5, 1, 0), (None, 1, 1)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        for got in (toxicity.apply(docs, toxicity.train(docs, table, F.lit(True))), quality.apply(docs, quality.train(docs, table, F.lit(True)))):
            rows = got.collect()
            assert len(rows) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
            scores = {r["doc_id"]: r["score"] for r in rows}
            assert scores[2] == scores[3]
    empty = docs.limit(0)
    assert toxicity.apply(empty, toxicity.train(empty, table, F.lit(True))).collect() == []


def test_words_are_those_of_a_plain_split():
    texts = ["A bé  c\n", "", None, " x", "x", "ÄB ab", "\t"]
    found = []
    for i, _, buf, offsets in chunks(pa.array(texts), 4):
        w = words(buf, offsets, SPACES)
        found += [(i + int(d), buf[a:b].tobytes().decode()) for d, a, b in zip(w.doc, w.start, w.end, strict=True)]
    assert found == [(i, x) for i, t in enumerate(texts) for x in (t or "").split()]


def _rows_of(texts):
    out = []
    for _, j, buf, offsets in chunks(pa.array(texts), 1 << 30):
        doc, bucket = toxicity.terms(buf, offsets)
        out += [np.unique(bucket[doc == i]).astype(np.int32) for i in range(j)]
    return out


def test_a_pair_of_words_that_tell_nothing_alone():
    """One label in twenty; each word stands in 40 texts, 8 of which are the same and toxic: z of about 4 alone is not reached, the pair's is large."""
    rng = np.random.default_rng(6)
    texts, labels = [], []
    for i in range(1000):
        extra = ["alpha", "omega"] if i < 8 else ["alpha"] if i < 70 else ["omega"] if i < 132 else []
        texts.append(" ".join(rng.permutation([f"v{x}" for x in rng.integers(0, 400, 5)] + extra)))
        labels.append(float(i < 8 or i >= 960))
    alone, n = _rows_of(texts), np.array(labels)
    share = (n.sum() + 1) / (len(n) + 2)
    m = toxicity.fit(n, alone)
    (word,) = [r for r in _rows_of(["alpha"])]
    have = np.array([np.isin(r, word).sum() == len(word) for r in alone])
    assert abs(n[have].sum() - have.sum() * share) / np.sqrt(have.sum() * share * (1 - share)) < 4
    assert (m.slot[word] >= 0).any()

    def score(t):
        (_, j, buf, offsets), = chunks(pa.array([t]))
        return m.score(j, *toxicity.terms(buf, offsets))[0]

    assert score("v1 alpha v2 omega v3") > 0.5 > 0.2 > max(score("v1 alpha v2 v5 v3"), score("v1 v9 v2 omega v3"))


def test_an_id_that_holds_a_third_of_all_rows_teaches_once(frame, spark):
    rows = [(i, f"text of {i}") for i in range(40)] + [(7, f"variant {i} of seven") for i in range(20)] + [(7, "the same again")] * 300
    docs = frame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    want = {r["doc_id"]: r["t"] for r in hashed.groupBy("doc_id").agg(F.min_by("text", "h").alias("t")).collect()}
    for sample in (11, 40):
        got = toxicity.labelled(docs, labels, "toxic", F.lit(True), sample, lambda texts: [t.encode() for t in texts.to_pylist()]).collect()
        assert len(got) == sample and {bytes(r["features"]).decode() for r in got} <= set(want.values())
        assert sorted(r["rank"] for r in got) == sorted({r["rank"] for r in got})
    whole = {bytes(r["features"]).decode() for r in got}
    assert whole == set(want.values())


def test_the_bound_on_terms_takes_the_first_documents_by_rank(frame, spark, monkeypatch):
    docs = frame([(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda y, rows: seen.append((len(y), sum(map(len, rows)))))
    for most in (10**6, 900, 10):
        toxicity.train(docs, labels, F.lit(True), most=most)
    assert seen[0][0] == 30 and 0 < seen[1][0] < 30 and seen[1][1] <= 900 and seen[2] == (0, 0)
