"""Filter, order and cut rows, with the dialect's NULL order and storage order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Value, sort_column


def sort_key(value: Value, descending: bool, nulls_first: bool | None = None) -> Column:
    """NULL sorts below everything unless said otherwise."""
    first = (not descending) if nulls_first is None else nulls_first
    c = sort_column(value)
    if descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def ordered(df: DataFrame, keys: list[Column], storage: tuple[str, ...]) -> DataFrame:
    """By the keys, then in storage order."""
    every = [*keys, *[F.col(c) for c in storage]]
    return df.orderBy(*every) if every else df


def cut(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
