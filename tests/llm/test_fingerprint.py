import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.llm import fingerprint as P


def naive(text):
    b = text.encode()
    counts = [0] * P.BUCKETS
    for at in range(len(b) - 4):
        w = b[at : at + 5]
        for salt, (i, j) in enumerate(P._TRIPLETS):
            h = (w[0] + (w[i] << 8) + (w[j] << 16) + (salt << 24)) * 0x9E3779B1 & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x85EBCA77 & 0xFFFFFFFF
            counts[h >> 24] += 1
    q = [sorted(counts)[P.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    return counts, [sum(c > x for x in q) for c in counts]


def levels(digest):
    return [x >> s & 3 for x in digest[2:] for s in (6, 4, 2, 0)]


def test_digests():
    texts = ["", "abcd", "abcde", "the quick brown fox jumps over the lazy dog " * 20, "é" * 500, None, "x" * 300_000]
    got = P.digests(pa.array(texts))
    for t, d in zip(texts[:5], got, strict=False):
        assert levels(d.tolist()) == naive(t)[1]
    assert (got[5] == got[0]).all()
    assert (P.likeness(got, got) == 1).all()
    assert (P.likeness(got[[0] * 7], got) >= 0).all() and P.likeness(got[3:4], got[4:5])[0] < 0.8


def test_walk_against_brute_force(frame):
    """Every row: in order of the id (null first), of rows that share an id by a hash of the text; after the last comes the first."""
    rows = [(i * 7 % 101, " ".join(f"w{(i * j) % 97}" for j in range(i))) for i in range(60)] + [(200, None), (201, ""), (150, "é" * 9), (150, "z"), (150, "z"), (None, "no id")]
    df = frame(rows, "doc_id long, text string")
    hashed = {(r[0], r[1]): r[2] for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r]))
    want = []
    for (d, t), (_, nxt) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        t, nxt = t or "", nxt or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own, new, after = P.digests(pa.array([t, edited, nxt]))
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes().hex(), new.tobytes().hex(), float(P.likeness(own[None], new[None])[0]), float(P.likeness(own[None], after[None])[0])))
    got = P.with_next(df.repartition(5)).collect()
    columns = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted((str(r["doc_id"]), *(r[c] for c in columns)) for r in got) == sorted(want)


def test_edges(frame):
    assert P.with_next(frame([], "doc_id long, text string")).collect() == []
    (r,) = P.with_next(frame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    assert len(P.with_next(frame([(None, "a"), (None, "a"), (2, "b")], "doc_id long, text string")).collect()) == 3


def test_columns(spark):
    df = spark.createDataFrame([("hello world, hello", "hello world, hallo"), (None, "")], "a string, b string")
    rows = df.select(P.similarity(P.fingerprint(df["a"]), P.fingerprint(df["b"]))).collect()
    assert 0.5 < rows[0][0] < 1 and rows[1][0] == 1
