"""The engine: tables and statements over a Spark session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from .plans.lowering import Lowering
from .plans.parser import parse
from .sources.catalogue import Catalogue


class Engine:
    def __init__(self, spark: SparkSession, sqlite: str | None = None, parquet: str | None = None):
        """sqlite: a database file whose tables to open; parquet: a local folder of <table>.parquet."""
        self.spark, self.catalogue = spark, Catalogue(spark)
        if sqlite:
            self.catalogue.add_sqlite(sqlite)
        if parquet:
            self.catalogue.add_parquet_folder(parquet)

    def plan(self, sql: str, params: Sequence | Mapping[str, object] = ()) -> DataFrame:
        """The statement as a lazy DataFrame; its names are resolved here. params: values for its variables, in order or by name."""
        return Lowering(self.catalogue).run(parse(sql, params))

    execute = plan

    def rows(self, sql: str, params: Sequence | Mapping[str, object] = ()) -> list[dict]:
        """All rows as dicts; of columns with one name the last wins."""
        df = self.plan(sql, params)
        return [dict(zip(df.columns, r, strict=True)) for r in df.collect()]

    def explain(self, sql: str) -> str:
        """Spark's plan for the statement, with or without EXPLAIN before it."""
        return self.plan(sql)._jdf.queryExecution().explainString(
            self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )

    def tables(self) -> list[str]:
        return self.catalogue.names()

    def close(self) -> None:
        """Forget the tables; the Spark session stays."""
        self.catalogue.tables.clear()
        self.catalogue.later.clear()
