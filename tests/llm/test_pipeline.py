"""The pipeline stage by stage, each against a plain version of it over its own input."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from larkspur.llm import quality, toxicity
from larkspur.llm.queries import QUERIES, tokenizer
from larkspur.llm.tokens import Encoder
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        out.append((name, docs.toPandas()))
        docs = spark.createDataFrame(out[-1][1], docs.schema)
    return spark.read.parquet(f"{DIR}/documents.parquet").toPandas(), out


def test_order_and_columns(stages):
    docs, out = stages
    assert [n for n, _ in out] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    assert all(list(df.columns) == list(docs.columns) for _, df in out[:-1])


def test_filters_drop_what_their_models_reject(spark, stages):
    docs, out = stages
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    before = spark.read.parquet(f"{DIR}/documents.parquet")
    machine = toxicity.train(before, labels, F.lit(True))
    want = {r["doc_id"] for r in toxicity.apply(before, machine).filter("predicted = 0").collect()}
    assert set(out[0][1].doc_id) == want
    model = quality.train(before, labels, F.lit(True))
    kept = spark.createDataFrame(out[0][1])
    assert set(out[1][1].doc_id) == {r["doc_id"] for r in quality.apply(kept, model).filter("predicted = 1").collect()}


def test_one_of_each_group_stays(stages):
    _, out = stages
    rows = [(r.doc_id, r.text) for r in out[1][1].itertuples()]
    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(out[2][1].doc_id) == {d for d in sets if find(d) == d}


def test_packing_covers_the_mix(stages):
    _, out = stages
    mixed, packed = out[3][1], out[4][1]
    assert set(mixed.doc_id) <= set(out[2][1].doc_id)
    encode = Encoder(tokenizer()).encode
    ids = {r.doc_id: np.frombuffer(encode(r.text) + (1).to_bytes(4, "little"), "<u4") for r in mixed.itertuples()}
    assert packed.length.sum() == sum(len(ids[d]) for d in mixed.doc_id)
    for r in packed.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_run_gives_as_many_tokens(spark, stages):
    assert corpus_pipeline.run(spark, DIR).agg(F.sum("length")).first()[0] == stages[1][4][1].length.sum()


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls, repeated and empty rows, a very long text, equal texts under one id and others; and columns named like the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, mix_at string, component string, node string, __hash string"
    base = spark.read.parquet(f"{DIR}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    some = next(r for r in rows if len(r[1].split()) > 40)
    rows += [(None, some[1], None, None, None), (5, None, "en", "web", 0), (5, "", "en", None, 0), (9000, some[1], None, "web", 1), (9000, "another text under the very same id, it is short", "en", "web", 1), (some[0], some[1], "en", "web", 1)]
    rows += [(9100, "word " * 200_000, "en", "web", 1_000_000), (9101, " \n\t ", None, None, None)]
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], schema), rows


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_rows(spark, odd, at):
    docs, rows = odd
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, DIR)
    got = out.collect()
    if name == "packing":
        encode = Encoder(tokenizer()).encode
        assert sum(r["length"] for r in got) == sum(len(encode(t or "")) // 4 + 1 for _, t, *_ in rows)
        return
    assert out.columns == docs.columns and all(r["score"] == r["mix_at"] == r["__hash"] == "clash" for r in got)
    have = sorted(str(r[:5]) for r in map(tuple, got))
    given = sorted(map(str, rows))
    if name == "near_duplicates":
        words = lambda t: (t or "").translate(LOWER).split()
        plain = {}
        for d, t, *rest in rows:
            w = words(t)
            plain.setdefault(tuple(w), []).append((d is None, d))
        kept = {(r["doc_id"], tuple(words(r["text"]))) for r in got}
        assert len(got) == len([1 for r in got if not words(r["text"])]) + len({w for _, w in kept if w})  # no two rows of one text
        assert sum(not words(r["text"]) for r in got) == sum(not words(t) for _, t, *_ in rows)
        for w, ids in plain.items():
            if w and any(k == w for _, k in kept):
                assert (min(ids)[1], w) in kept  # the smallest id of those with this text
        assert any(r["doc_id"] == 9000 for r in got)  # its other text is no copy
    if name in ("toxicity", "quality"):  # each row by its text alone, whatever its id
        assert set(have) <= set(given) and all(have.count(x) == given.count(x) for x in have)
        judged = {}
        for r in rows:
            judged.setdefault(r[1] or "", set()).add(str(r) in have)
        assert all(len(x) == 1 for x in judged.values())
    if name == "mixing":
        assert set(have) <= set(given) and {r["source"] for r in got} <= {r[3] for r in rows}


@pytest.mark.parametrize("at", range(5))
def test_stages_on_an_empty_table(spark, odd, at):
    docs, _ = odd
    out = corpus_pipeline.STAGES[at][1](spark, docs.limit(0), DIR)
    assert out.collect() == [] and (at == 4 or out.columns == docs.columns)


def test_the_pipelines_tables_go(spark):
    import os

    from larkspur.llm import store

    folder = f"{store.shared_dir(spark)}/larkspur"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    corpus_pipeline.run(spark, DIR).collect()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"pipeline-mixing", "packing"}  # what the last stage's rows are read from


def test_a_cluster_without_a_shared_folder_is_refused():
    from larkspur.llm import store

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Session())
