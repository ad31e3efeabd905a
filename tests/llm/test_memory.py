import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larkspur.llm import jaccard, quality, text, toxicity


def prose(n, words=450, seed=3):
    rng = np.random.default_rng(seed)
    return [" ".join(map("w{}".format, rng.integers(0, 20_000, words))) for _ in range(n)]


def peak(work):
    text._powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_many_texts_take_little_memory_at_once():
    some = pa.array(prose(2_500))

    def each(work):
        return peak(lambda: [work(j - i, buf, offsets) for i, j, buf, offsets in text.chunks(some)][:0])

    assert each(lambda n, buf, offsets: len(quality.features(n, buf, offsets))) < 48 << 20
    assert each(lambda n, buf, offsets: len(toxicity.terms(buf, offsets)[0])) < 48 << 20
    assert each(lambda n, buf, offsets: sum(map(len, jaccard.sets_of(buf, offsets, 5)))) < 48 << 20


def test_routing_gives_all_its_keys_in_small_batches():
    texts = prose(1_600, 120)
    columns = [pa.array(range(1_600), pa.int64()), pa.array(range(1_600), pa.int64()), pa.array(texts)]
    out = list(jaccard._route(5, 80, 100)(iter([pa.record_batch(columns, names=["doc_id", "text_hash", "text"])])))
    assert max(b.num_rows for b in out) <= 1 << 16
    rows = pa.Table.from_batches(out)
    keyed = rows.filter(pc.is_valid(rows["key"]))
    want = set()
    for _, _, buf, offsets in text.chunks(columns[2]):
        want |= {x for s in jaccard.sets_of(buf, offsets, 5) for x in jaccard.keys_of(s, 80, 100).view(np.int64).tolist()}
    assert len(keyed) > 1 << 16 and sorted(want) == sorted(keyed["key"].to_pylist())


def test_edges_of_keys_are_joined_before_they_are_many():
    n = 1 << 20
    key, node = np.repeat(np.arange(n // 2, dtype=np.int64), 2), np.arange(n, dtype=np.int64)
    batches = [pa.record_batch([pa.array(key[i : i + 10_000]), pa.array(node[i : i + 10_000])], names=["key", "node"]) for i in range(0, n, 10_000)]
    out = []
    assert peak(lambda: out.extend(jaccard._meet(iter(batches)))) < 112 << 20
    assert {(a, b) for x in out for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)} == {(2 * i, 2 * i + 1) for i in range(n // 2)}
