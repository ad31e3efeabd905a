"""Statements over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.lowering import Lowering, aggregates, walk
from ..plans.nodes import Exists, InQuery, Scalar, Select, Windowed
from ..plans.parser import parse
from ..sources.catalogue import Catalogue


class StatefulStatement(ValueError):
    """The statement needs all its rows before the first result."""


def _stateless(statement: Select) -> bool:
    core = statement.cores[0]
    if len(statement.cores) > 1 or statement.ctes or statement.order or statement.limit is not None or statement.offset:
        return False
    if core.source is None or core.distinct or core.group or core.having or core.joins or aggregates(core.items):
        return False
    if any(isinstance(x, (Windowed, InQuery, Exists, Scalar)) for x in walk((core.items, core.where or ()))):
        return False
    return not isinstance(core.source.table, Select) or _stateless(core.source.table)


def plan_stream(sql: str, streams: dict[str, DataFrame]) -> DataFrame:
    """A statement over streaming DataFrames by name. Projection, expressions and predicates carry over; what needs all rows
    (ORDER BY, LIMIT, DISTINCT, GROUP BY, aggregates, window functions, set operations, joins, subqueries of expressions, WITH) is refused here
    rather than when the stream starts."""
    statement = parse(sql)
    if not _stateless(statement):
        raise StatefulStatement("only projection and predicates run on a stream")
    if not next(iter(streams.values())).isStreaming:
        raise ValueError("not a stream")
    catalogue = Catalogue(next(iter(streams.values())).sparkSession)
    for name, df in streams.items():
        catalogue.add_frame(name, df)
    return Lowering(catalogue).run(statement)
