"""The engine's tables, by name without regard to case."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import MIXED
from .schema_text import IndexInfo, has_rowid
from .sqlite_file import ROWID, FileTable, SqliteSource, read_catalogue

_AFFINITY = {"int": "integer", "real": "real", "text": "text", "blob": "blob", "mixed": "blob"}


def kind_of(t: T.DataType) -> str:
    """An expression class for a Spark type; dates and times are text to expressions, nested types take no part."""
    if t == MIXED:
        return "mixed"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "text"
    return "blob" if isinstance(t, T.BinaryType) else "null" if isinstance(t, T.NullType) else "other"


@dataclass
class Table:
    name: str
    columns: list[str]
    frame: Callable[[], DataFrame]  # the columns
    numbered: Callable[[], DataFrame] | None  # with ROWID
    kinds: dict[str, str]
    affinities: dict[str, str]
    rowid_alias: str | None = None
    indexes: tuple[IndexInfo, ...] = ()
    sql: str = ""
    #: Columns, of what ordered() gives, that put the rows in storage order.
    order: tuple[str, ...] = (ROWID,)
    ordered: Callable[[], DataFrame] | None = field(default=None)
    #: Files in storage order; LIMIT reads no more of them than it needs, through part(number of files), which is like ordered().
    files: Callable[[], list[str]] = field(default=list)
    part: Callable[[int], DataFrame] | None = field(default=None)


class Catalogue:
    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}
        self.later: dict[str, Callable[[], Table]] = {}  # tables that are opened when first named

    def add(self, table: Table) -> Table:
        self.tables[table.name.lower()] = table
        return table

    def get(self, name: str) -> Table:
        key = name.lower()
        if key in self.later:
            self.later[key]()  # stays if it fails
            del self.later[key]
        found = self.tables.get(key)
        if found is None:
            raise LookupError(f"no such table: {name}")
        return found

    def names(self) -> list[str]:
        return sorted({*self.tables, *self.later})

    def _typed(self, name: str, df: DataFrame, **more) -> Table:
        kinds = {f.name: kind_of(f.dataType) for f in df.schema}
        return self.add(Table(name, df.columns, kinds=kinds, affinities={c: _AFFINITY.get(k, "blob") for c, k in kinds.items()}, **more))

    def add_frame(self, name: str, df: DataFrame, rowid: str | None = None) -> Table:
        """A DataFrame; rowid names its column of row ids, which is no column of the table."""
        plain = df.drop(rowid) if rowid else df
        numbered = (lambda: df.withColumnRenamed(rowid, ROWID)) if rowid else None
        return self._typed(name, plain, frame=lambda: plain, numbered=numbered, ordered=numbered)

    def add_parquet(self, name: str, path: str) -> Table:
        """Parquet files. A single file's row ids are its row numbers from 1; several files' go on from file to file, by
        path, and are made only where a statement names them: LIMIT without ORDER BY goes by (file, row)."""
        df = self.spark.read.parquet(path)
        place = {"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")}
        single = len(df.inputFiles()) == 1

        def numbered() -> DataFrame:
            if single:
                return df.withColumn(ROWID, place["__row"] + 1)
            rows = df.withColumns(place)
            sizes = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
            before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # over files, not rows
            starts = sizes.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
            return rows.join(starts, "__file").withColumn(ROWID, F.col("__before") + F.col("__row") + 1).drop("__file", "__row", "__before")

        @functools.cache
        def files() -> list[str]:
            found = [] if single else sorted(map(unquote, df.inputFiles()))
            return found if not any(set(f) & set("*?[]{}\\") for f in found) else []  # those would be read as patterns

        def part(k: int) -> DataFrame:
            base = self.spark.read.schema(df.schema).option("basePath", path)
            return base.parquet(*files()[:k]).withColumns(place)

        ordered = numbered if single else lambda: df.withColumns(place)
        return self._typed(name, df, frame=lambda: df, numbered=numbered, ordered=ordered, order=(ROWID,) if single else ("__file", "__row"), files=files, part=part)

    def add_parquet_folder(self, folder: str) -> list[str]:
        """Every <name>.parquet in a local folder."""
        names = sorted(x.removesuffix(".parquet") for x in os.listdir(folder) if x.endswith(".parquet"))
        for name in names:
            self.later[name.lower()] = lambda name=name: self.add_parquet(name, f"{folder}/{name}.parquet")
        return names

    def add_sqlite(self, path: str) -> list[str]:
        """Every table of a SQLite file, opened when a statement first names it."""
        self.spark.dataSource.register(SqliteSource)
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        found = read_catalogue(path)
        for key, table in found.items():
            self.later[key] = lambda table=table: self._sqlite_table(path, table)
        return sorted(found)

    def _sqlite_table(self, path: str, table: FileTable) -> Table:
        """A column is of one class if all its values are, else MIXED; that is found by a distributed scan of the records, once."""
        if not has_rowid(table.sql):
            raise LookupError(f"table {table.name} is WITHOUT ROWID, which is not supported")
        reader = lambda: self.spark.read.format("sqlite_file").option("path", path).option("table", table.name)
        seen: dict[int, set[str]] = {}
        for row in reader().option("mode", "classes").load().distinct().collect():  # at most five rows a column
            seen.setdefault(row["at"], set()).add(row["kind"])
        kinds = []
        for i, c in enumerate(table.columns):
            found = seen.get(i, set()) - {"null"}
            empty = {"integer": "int", "text": "text", "real": "real"}.get(c.affinity, "mixed")
            kinds.append(found.pop() if len(found) == 1 else "mixed" if found else empty)
        load = reader().option("kinds", ",".join(kinds)).load
        names = [c.name for c in table.columns]
        return self.add(Table(
            table.name, names, frame=lambda: load().drop(ROWID), numbered=load, ordered=load,
            kinds=dict(zip(names, kinds, strict=True)), affinities={c.name: c.affinity for c in table.columns},
            rowid_alias=next((c.name for c in table.columns if c.is_rowid), None), indexes=table.indexes, sql=table.sql,
        ))
