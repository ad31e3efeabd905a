"""Packing: bounded-space online packing of documents into sequences.

Each partition keeps `windows` open windows. A document's ids (and the end id) first fill whole sequences of their
own; what is left goes, in one piece, into the open window that it fits best. If it fits none, the
fullest window leaves: with a gap of at most `gap` it leaves padded, else the document's head is cut to fill it. At the
end of a partition the open windows go on to a merge, where those of up to PARTITIONS partitions fill each other up: the emptiest
are cut to fill the fullest. One sequence of such a group stays short.

Texts are read whole, a very long one in one go, and each id lies in exactly one piece. Nothing is shuffled but the open windows: at most windows *
length ids a partition, so a merge task gets at most PARTITIONS * windows * length ids (4 MB by default). Sequence ids are unique, not consecutive.

Defined results: null and empty texts are the end id alone; repeated rows and ids are packed each; null ids stay null; an
empty table gives no rows; columns of docs but doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .tokens import encoder

LENGTH, WINDOWS, GAP, PARTITIONS, END = 2048, 64, 32, 8, 1
_MERGED = 1 << 62
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, __group int, __window long"
_FIELDS = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary()), ("__group", pa.int32()), ("__window", pa.int64())])


class _Open:
    """An open window: pieces as (doc, start, ids, document's ids)."""

    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces, self.used = [], 0

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc, start, ids, total))
        self.used += len(ids) // 4


class Packer:
    def __init__(self, length: int, windows: int, gap: int):
        self.length, self.windows, self.gap = length, windows, gap
        self.open: list[tuple[int, int, _Open]] = []  # (room, number, window), by room
        self.made = 0

    def place(self, doc, ids: bytes) -> Iterator[list]:
        """Take a document; gives the sequences, lists of pieces, that are finished by it."""
        total, step, at = len(ids) // 4, 4 * self.length, 0
        while len(ids) - at >= step:
            yield [(doc, at // 4, ids[at : at + step], total)]
            at += step
        while at < len(ids):
            need = (len(ids) - at) // 4
            i = bisect_left(self.open, need, key=lambda x: x[0])
            if i < len(self.open):
                room, number, w = self.open.pop(i)
                w.add(doc, at // 4, ids[at:], total)
                at = len(ids)
            elif len(self.open) < self.windows:
                room, number, w = self.length, self.made, _Open()
                self.made += 1
                w.add(doc, at // 4, ids[at:], total)
                at = len(ids)
            else:
                room, number, w = self.open.pop(0)
                if room > self.gap:
                    w.add(doc, at // 4, ids[at : at + 4 * room], total)
                    at += 4 * room
                yield w.pieces
                continue
            if w.used == self.length:
                yield w.pieces
            else:
                insort(self.open, (self.length - w.used, number, w), key=lambda x: x[:2])


def _rows(pieces: list, sequence: int, with_ids: bool, group=None, window=None) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in pieces:
        n = len(ids) // 4
        yield doc, start, n, zlib.crc32(ids), total, sequence, offset, ids if with_ids else None, group, window
        offset += n


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)


def _pack(path: str, length: int, windows: int, gap: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, encode, stop = Packer(length, windows, gap), encoder(path).encode, end.to_bytes(4, "little")
        sequence, out = part << 32, []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for pieces in packer.place(doc, encode(text.as_py() or "") + stop):
                    out += _rows(pieces, sequence, with_ids)
                    sequence += 1
                if len(out) > 2000:
                    yield _record(out)
                    out = []
        for _, number, w in packer.open:
            out += _rows(w.pieces, 0, True, part // PARTITIONS, part << 32 | number)
        yield _record(out)

    return run


def _merge(length: int, with_ids: bool):
    def run(table: pa.Table) -> pa.Table:
        held: dict[int, list] = {}
        columns = (table.column(c).to_pylist() for c in ("__window", "offset", "doc_id", "start", "ids", "doc_tokens"))
        group = table.column("__group")[0].as_py()
        for window, offset, *piece in sorted(zip(*columns, strict=True), key=lambda r: r[:2]):
            held.setdefault(window, []).append(tuple(piece))
        used = lambda pieces: sum(len(p[2]) for p in pieces) // 4
        queue = sorted(held.values(), key=used)  # the emptiest first
        sequence, out = _MERGED + (group << 32), []
        while queue:
            pieces = queue.pop()
            room = length - used(pieces)
            while room and queue:
                doc, start, ids, total = queue[0].pop()
                n = min(room, len(ids) // 4)
                if n < len(ids) // 4:  # its tail is taken, its head stays
                    queue[0].append((doc, start, ids[: -4 * n], total))
                    start, ids = start + len(ids) // 4 - n, ids[-4 * n :]
                pieces.append((doc, start, ids, total))
                room -= n
                if not queue[0]:
                    queue.pop(0)
            out += _rows(pieces, sequence, with_ids)
            sequence += 1
        return pa.Table.from_batches([_record(out)])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, windows: int = WINDOWS, gap: int = GAP, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null unless asked for).
    tokenizer: a file of the tokenizers library, at the same path on every executor."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = materialize(rows.mapInArrow(_pack(tokenizer, length, windows, gap, end, with_ids), _SCHEMA), "packing")
    merged = held.filter(F.col("__group").isNotNull()).groupBy("__group").applyInArrow(_merge(length, with_ids), _SCHEMA)
    return held.filter(F.col("__group").isNull()).unionByName(merged).drop("__group", "__window")
