"""UNION, UNION ALL, EXCEPT, INTERSECT over columns by position."""

from __future__ import annotations

from pyspark.sql import DataFrame


def combine(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    match op:
        case "UNION ALL":
            return a.union(b)
        case "UNION":
            return a.union(b).distinct()
        case "EXCEPT":
            return a.subtract(b)
        case "INTERSECT":
            return a.intersect(b)
    raise ValueError(op)
