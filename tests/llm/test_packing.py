import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import packing
from larkspur.llm.queries import tokenizer
from larkspur.llm.tokens import Encoder

SPECIAL = "<|endoftext|>"

TEXTS = ["", "a", "Hello, world! It's 12 o'clock.", "  two  spaces   three\n\n lines \t x ", "é ñ 漢字 🎉🎉 ß", "x" * 3000, " lead", "trail ", f"a {SPECIAL} b", "don't can't we'll 've", " nb sp ​", "a \n b", "½ ² ٣ x_y", "1 2  3"]


def test_ids_are_the_tokenizer_librarys():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(tokenizer()), Encoder(tokenizer())
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["the", " ", "  ", "\n", "Ab", ",", "'s", "é", "7", "\t", "."]) for _ in range(40)) for _ in range(400)]
    for t in texts * 2:
        assert np.frombuffer(fast.encode(t), "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids, t


def test_without_the_twin(monkeypatch):
    e = Encoder(tokenizer())
    want = [e.encode(t) for t in TEXTS]
    e.fast = None
    assert [e.encode(t) for t in TEXTS] == want


@pytest.mark.parametrize("windows", [1, 3, 64])
def test_packer_is_lossless_and_tight(windows):
    rng = random.Random(windows)
    p, out = packing.Packer(128, windows, 4), []
    docs = {i: rng.randbytes(4 * rng.choice([1, 5, 60, 127, 128, 129, 500])) for i in range(400)}
    for i, ids in docs.items():
        out += p.place(i, ids)
    assert len(p.open) <= windows
    gaps = [128 - sum(len(x[2]) for x in s) // 4 for s in out]
    assert all(0 <= g <= 4 for g in gaps)
    out += [w.pieces for _, _, w in p.open]
    got: dict = {}
    for s in out:
        for doc, start, ids, _ in s:
            got.setdefault(doc, []).append((start, ids))
    for i, ids in docs.items():
        at, whole = 0, b""
        for start, part in sorted(got[i]):
            assert start == at
            at, whole = at + len(part) // 4, whole + part
        assert whole == ids


def plain_packing(docs, length, windows, gap):
    """The placement again, without indexes: lists of windows, each a list of (doc, start, length)."""
    opened, done = [], []
    room = lambda w: length - sum(n for _, _, n in w)
    for doc, total in docs:
        at = 0
        while total - at >= length:
            done.append([(doc, at, length)])
            at += length
        while at < total:
            fits = [w for w in opened if room(w) >= total - at]
            if fits:
                w = min(fits, key=room)
                w.append((doc, at, total - at))
                at = total
                if room(w) == 0:
                    opened.remove(w)
                    done.append(w)
            elif len(opened) < windows:
                opened.append([(doc, at, total - at)])
                at = total
            else:
                w = min(opened, key=room)
                opened.remove(w)
                if room(w) > gap:
                    n = room(w)
                    w.append((doc, at, n))
                    at += n
                done.append(w)
    return done, opened


@pytest.mark.parametrize(("windows", "gap"), [(1, 0), (4, 4), (16, 8)])
def test_packer_against_brute_force(windows, gap):
    rng = random.Random(windows)
    docs = [(i, rng.choice([1, 2, 30, 63, 64, 65, 100, 200])) for i in range(300)]
    p, got = packing.Packer(64, windows, gap), []
    for i, n in docs:
        got += p.place(i, bytes(4 * n))
    as_rows = lambda ws: [[(d, at, len(ids) // 4) for d, at, ids, _ in w] for w in ws]
    done, opened = plain_packing(docs, 64, windows, gap)
    assert as_rows(got) == done
    # of windows with the same room, which one is taken makes no difference to what fits
    assert sorted(as_rows([w.pieces for _, _, w in p.open])) == sorted(opened)


def test_merge_leaves_one_short_sequence_a_group():
    rng = random.Random(5)
    rows, docs = [], {}
    for w in range(40):
        offset = 0
        for _ in range(rng.randint(1, 3)):
            ids = rng.randbytes(4 * rng.randint(1, 30))
            docs[len(docs)] = ids
            rows.append((len(docs) - 1, 0, len(ids) // 4, 0, len(ids) // 4, 0, offset, ids, 3, w))
            offset += len(ids) // 4
    out = packing._merge(100, True)(pa.Table.from_batches([packing._record(rows)])).to_pylist()
    used = Counter()
    for r in out:
        used[r["sequence_id"]] += r["length"]
    assert sum(n < 100 for n in used.values()) <= 1 and max(used.values()) <= 100
    for d, ids in docs.items():
        parts = sorted((r["start"], bytes(r["ids"])) for r in out if r["doc_id"] == d)
        assert b"".join(x for _, x in parts) == ids and [a for a, _ in parts] == [sum(len(x) // 4 for _, x in parts[:i]) for i in range(len(parts))]


def test_a_vocabulary_whose_twin_differs_goes_without_it(tmp_path):
    import shutil

    shutil.copy(tokenizer(), tmp_path / "v.json")
    lines = open(tokenizer().removesuffix(".json") + ".tiktoken", "rb").read().splitlines()
    swapped = [b" ".join([a.split()[0], b.split()[1]]) for a, b in zip(lines, [*lines[1:], lines[0]], strict=True)]
    (tmp_path / "v.tiktoken").write_bytes(b"\n".join(swapped))
    e = Encoder(str(tmp_path / "v.json"))
    assert e.fast is None and e.encode("Hello, world") == Encoder(tokenizer()).encode("Hello, world")
    shutil.copy(tokenizer().removesuffix(".json") + ".tiktoken", tmp_path / "v.tiktoken")
    assert Encoder(str(tmp_path / "v.json")).fast is not None


def test_table(frame):
    rows = [(i, "some words here " * (i % 40)) for i in range(120)] + [(500, None), (501, ""), (None, "null id"), (7, "again"), (7, "again"), (600, "long text " * 30_000)]
    got = packing.pack(frame(rows, "doc_id long, text string").repartition(4), tokenizer(), 256, 8, with_ids=True).collect()
    encode = Encoder(tokenizer()).encode
    total = sum(len(encode(t or "")) // 4 + 1 for _, t in rows)
    assert sum(r["length"] for r in got) == total
    sequences: dict = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
        sequences.setdefault(r["sequence_id"], []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert len(sequences) * 256 < total * 1.1 + 2 * 256
    by_doc = sorted((r["start"], bytes(r["ids"])) for r in got if r["doc_id"] == 600)
    assert b"".join(i for _, i in by_doc) == encode("long text " * 30_000) + (1).to_bytes(4, "little")
    assert packing.pack(frame([], "doc_id long, text string"), tokenizer()).collect() == []
