"""SQLite 3 database files as a Spark data source, read in parallel by leaf pages.

The driver reads the header, the catalogue page and the interior pages of a table's tree; leaf pages, with
overflow chains, are read and decoded by the tasks. The file must lie at the same path for driver and executors.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from .schema_text import ColumnInfo, IndexInfo, columns_of, index_of

MAGIC = b"SQLite format 3\x00"
ROWID = "__rowid"
_BATCH = 8192
_INTS = {1: 1, 2: 2, 3: 3, 4: 4, 5: 6, 6: 8}


class NotADatabase(ValueError):
    pass


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = 0
    for i in range(8):
        x = b[at + i]
        n = n << 7 | x & 0x7F
        if x < 0x80:
            return n, at + i + 1
    n = n << 8 | b[at + 8]
    return (n - (1 << 64) if n >= 1 << 63 else n), at + 9


@dataclass(frozen=True)
class Header:
    page_size: int
    usable: int
    pages: int
    encoding: str

    @staticmethod
    def read(f: BinaryIO) -> Header:
        h = f.read(100)
        if len(h) < 100 or h[:16] != MAGIC:
            raise NotADatabase("file is not a database")
        size = struct.unpack(">H", h[16:18])[0]
        size = 65536 if size == 1 else size
        (change, pages), (valid,) = struct.unpack(">II", h[24:32]), struct.unpack(">I", h[92:96])
        if not pages or change != valid:
            pages = f.seek(0, 2) // size
        text = struct.unpack(">I", h[56:60])[0]
        return Header(size, size - h[20], pages, {2: "utf-16-le", 3: "utf-16-be"}.get(text, "utf-8"))


class Pages:
    def __init__(self, path: str):
        for kind in ("-wal", "-journal"):
            if os.path.exists(path + kind) and os.path.getsize(path + kind):
                raise NotADatabase(f"{path}{kind} has content: the file alone is not the database; open and close it with SQLite first")
        self.file = open(path, "rb")  # noqa: SIM115
        self.header = Header.read(self.file)

    def close(self) -> None:
        self.file.close()

    def page(self, n: int) -> bytes:
        self.file.seek((n - 1) * self.header.page_size)
        return self.file.read(self.header.page_size)

    def _kind(self, n: int, page: bytes) -> int:
        kind = page[100 if n == 1 else 0]
        if kind not in (5, 13):
            raise NotADatabase(f"page {n} is no table page")
        return kind

    def _below(self, n: int) -> list[int]:
        """An interior page's children, in key order."""
        page, at = self.page(n), 100 if n == 1 else 0
        self._kind(n, page)
        cells = struct.unpack(">H", page[at + 3 : at + 5])[0]
        found = [struct.unpack(">I", page[p : p + 4])[0] for p in struct.unpack(f">{cells}H", page[at + 12 : at + 12 + 2 * cells])]
        return [*found, struct.unpack(">I", page[at + 8 : at + 12])[0]]

    def leaves(self, root: int) -> list[int]:
        """A table tree's leaf pages, in key order. All leaves are on one level, so of each level only the first page is read to learn its kind:
        besides the interior pages, one leaf is."""
        level = [root]
        while self._kind(level[0], self.page(level[0])) == 5:
            level = [child for n in level for child in self._below(n)]
        return level

    def rows(self, leaf: int) -> Iterator[tuple[int, bytes]]:
        """(rowid, record) of each cell."""
        page, at = self.page(leaf), 100 if leaf == 1 else 0
        cells = struct.unpack(">H", page[at + 3 : at + 5])[0]
        usable = self.header.usable
        most, least = usable - 35, (usable - 12) * 32 // 255 - 23
        for p in struct.unpack(f">{cells}H", page[at + 8 : at + 8 + 2 * cells]):
            size, p = _varint(page, p)
            rowid, p = _varint(page, p)
            if size <= most:
                yield rowid, page[p : p + size]
                continue
            here = least + (size - least) % (usable - 4)
            here = here if here <= most else least
            parts, left = [page[p : p + here]], size - here
            follow = struct.unpack(">I", page[p + here : p + here + 4])[0]
            while left > 0 and follow:
                over = self.page(follow)
                parts.append(over[4 : 4 + min(left, usable - 4)])
                left -= len(parts[-1])
                follow = struct.unpack(">I", over[:4])[0]
            yield rowid, b"".join(parts)


def decode(record: bytes, encoding: str = "utf-8") -> list:
    """A record's values: None, int, float, str or bytes."""
    end, at = _varint(record, 0)
    out, body = [], end
    while at < end:
        kind, at = _varint(record, at)
        if kind in _INTS:
            n = _INTS[kind]
            out.append(int.from_bytes(record[body : body + n], "big", signed=True))
            body += n
        elif kind == 0:
            out.append(None)
        elif kind == 7:
            out.append(struct.unpack(">d", record[body : body + 8])[0])
            body += 8
        elif kind in (8, 9):
            out.append(kind - 8)
        elif kind >= 12:
            n = (kind - 12) // 2
            raw = record[body : body + n]
            out.append(raw.decode(encoding, "replace") if kind % 2 else raw)
            body += n
        else:
            raise NotADatabase(f"reserved serial type {kind}")
    return out


@dataclass(frozen=True)
class FileTable:
    name: str
    root: int
    columns: tuple[ColumnInfo, ...]
    indexes: tuple[IndexInfo, ...]
    sql: str


def read_catalogue(path: str) -> dict[str, FileTable]:
    """The file's tables by lower-cased name, without the internal ones."""
    pages = Pages(path)
    try:
        if pages.header.pages == 0:
            return {}
        entries = [decode(r, pages.header.encoding) for leaf in pages.leaves(1) for _, r in pages.rows(leaf)]
    finally:
        pages.close()
    indexes = [index_of(sql) for kind, _, _, _, sql in entries if kind == "index" and sql]
    out = {}
    for kind, name, _, root, sql in entries:
        if kind == "table" and not name.lower().startswith("sqlite_") and root:
            own = tuple(i for i in indexes if i.table.lower() == name.lower())
            out[name.lower()] = FileTable(name, root, tuple(columns_of(sql)), own, sql)
    return out


def value_class(v: object) -> str:
    return {type(None): "null", int: "int", float: "real", str: "text", bytes: "blob"}[type(v)]


def spark_type(kind: str) -> T.DataType:
    from ..functions.values import MIXED

    return {"int": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType()}.get(kind, MIXED)


def _as_mixed(v: object) -> dict | None:
    if v is None:
        return None
    out = {"cls": 1, "num": None, "i": None, "t": None, "b": None}
    if isinstance(v, int):
        return out | {"num": float(v), "i": v}
    if isinstance(v, float):
        return out | {"num": v}
    return out | ({"cls": 2, "t": v} if isinstance(v, str) else {"cls": 3, "b": v})


_ARROW = {
    "int": pa.int64(), "real": pa.float64(), "text": pa.string(), "blob": pa.binary(),
    "mixed": pa.struct([("cls", pa.int8()), ("num", pa.float64()), ("i", pa.int64()), ("t", pa.string()), ("b", pa.binary())]),
}


@dataclass
class LeafRange(InputPartition):
    leaves: tuple[int, ...]


_TESTS = {
    EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, In: lambda v, x: v in x,
}


class SqliteReader(DataSourceReader):
    """options: path, table, kinds (by column, comma-separated), pages_per_task; or mode=classes, which gives the
    classes that occur in each column."""

    def __init__(self, options: dict):
        self.path, self.table = options["path"], options["table"].lower()
        self.kinds = [k for k in options.get("kinds", "").split(",") if k]
        self.scan_classes = options.get("mode") == "classes"
        self.per_task = int(options.get("pages_per_task", 512))
        self.tests: list[tuple[int, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        names = [c.name for c in read_catalogue(self.path)[self.table].columns]
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            at = -1 if column == ROWID else names.index(column) if column in names else None
            if type(f) in _TESTS and at is not None and (at < 0 or self.kinds[at] != "mixed"):
                self.tests.append((at, type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[LeafRange]:
        pages = Pages(self.path)
        try:
            leaves = pages.leaves(read_catalogue(self.path)[self.table].root)
        finally:
            pages.close()
        return [LeafRange(tuple(leaves[i : i + self.per_task])) for i in range(0, len(leaves), self.per_task)]

    def read(self, partition: LeafRange) -> Iterator[pa.RecordBatch]:
        pages = Pages(self.path)
        table = read_catalogue(self.path)[self.table]
        alias = next((i for i, c in enumerate(table.columns) if c.is_rowid), None)
        reals = [i for i, c in enumerate(table.columns) if c.affinity == "real"]
        width = len(table.columns)
        tests = [(at, {k.__name__: t for k, t in _TESTS.items()}[kind], x) for at, kind, x in self.tests]
        seen: set[tuple[int, str]] = set()
        rows: list[list] = []
        for leaf in partition.leaves:
            for rowid, record in pages.rows(leaf):
                v = decode(record, pages.header.encoding)
                v += [None] * (width - len(v))
                if alias is not None:
                    v[alias] = rowid
                for i in reals:
                    if isinstance(v[i], int):
                        v[i] = float(v[i])
                if self.scan_classes:
                    seen.update((i, value_class(x)) for i, x in enumerate(v))
                    continue
                if all((x := rowid if at < 0 else v[at]) is not None and test(x, to) for at, test, to in tests):
                    rows.append([*v[:width], rowid])
                if len(rows) >= _BATCH:
                    yield self._batch(rows, table)
                    rows = []
        pages.close()
        if self.scan_classes:
            found = sorted(seen)
            yield pa.record_batch([pa.array([i for i, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string())], names=["at", "kind"])
        elif rows:
            yield self._batch(rows, table)

    def _batch(self, rows: list[list], table: FileTable) -> pa.RecordBatch:
        arrays = []
        for column, kind in zip(zip(*rows, strict=True), [*self.kinds, "int"], strict=True):
            arrays.append(pa.array([_as_mixed(x) for x in column] if kind == "mixed" else column, _ARROW[kind]))
        return pa.record_batch(arrays, names=[*[c.name for c in table.columns], ROWID])


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> T.StructType:
        if self.options.get("mode") == "classes":
            return T.StructType([T.StructField("at", T.IntegerType()), T.StructField("kind", T.StringType())])
        table = read_catalogue(self.options["path"])[self.options["table"].lower()]
        kinds = self.options["kinds"].split(",")
        fields = [T.StructField(c.name, spark_type(k)) for c, k in zip(table.columns, kinds, strict=True)]
        return T.StructType([*fields, T.StructField(ROWID, T.LongType())])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options)
