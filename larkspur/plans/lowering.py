"""From a statement tree to a DataFrame.

The steps of a plain SELECT are scan, filter, sort, offset, limit, project: sorting comes before projection, so keys
need not be selected. Names mean a real column first, then a column alias, then the row id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, is_dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import values as V
from ..functions.calls import aggregate, choose, collated, constant, edge, is_aggregate, like, scalar, where, windowed
from ..functions.values import Value
from ..operators.rows import cut, ordered, sort_key
from ..operators.sets import combine
from ..sources.catalogue import Catalogue
from ..sources.sqlite_file import ROWID
from .nodes import (
    Between, Binary, Call, Case, Cast, Collate, Core, Exists, InList, InQuery, IsNull, Item, Join, Key, Literal, Name, Node, Scalar, Select, Source, Star,
    Unary, Windowed, title,
)

ROWID_NAMES = ("rowid", "_rowid_", "oid")


def walk(node: object) -> Iterator[object]:
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x)
    elif is_dataclass(node):
        yield node
        if not isinstance(node, (Select, Source)):
            for f in fields(node):
                yield from walk(getattr(node, f.name))


@dataclass
class Field:
    name: str
    raw: Column  # as stored
    value: Value  # as expressions see it
    hidden: bool = False  # the right side of USING


@dataclass
class Part:
    """One table of FROM."""

    alias: str
    columns: dict[str, Field]
    rowid: Value | None


def _value_of(raw: Column, kind: str, affinity: str | None) -> Value:
    col = {"int": raw, "real": raw.cast("double"), "text": raw.cast("string")}.get(kind, raw)
    return Value(col, kind, affinity, simple=True)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Scope:
    def __init__(self, parts: list[Part], lowering: Lowering):
        self.parts, self.aliases = parts, {}
        self.known: dict[Node, Value] = {}  # grouped expressions
        self.storage: tuple[str, ...] = ()  # columns of the storage order, which decides between peers of a window
        self.lowering, self.outer = lowering, lowering.outer  # outer: the scope around a subquery
        self.base = lowering.base  # begins the names of a subquery's columns, which must differ from those around it

    def column(self, node: Name) -> Field | None:
        key = node.name.lower()
        found = [
            p.columns[key] for p in self.parts
            if key in p.columns and (node.table is None or node.table.lower() == p.alias) and not (p.columns[key].hidden and node.table is None)
        ]
        if len(found) > 1:
            raise LookupError(f"ambiguous column name: {node.name}")
        return found[0] if found else None

    def name(self, node: Name) -> Value:
        if field := self.column(node):
            return field.value
        if node.table is None and node.name.lower() in self.aliases:
            expr = self.aliases[node.name.lower()]
            hidden = self.aliases
            self.aliases = {k: v for k, v in hidden.items() if k != node.name.lower()}  # no alias means itself
            try:
                return self.value(expr)
            finally:
                self.aliases = hidden
        if node.name.lower() in ROWID_NAMES:
            some = [p.rowid for p in self.parts if (node.table is None or node.table.lower() == p.alias)]
            if len(some) == 1 and some[0] is not None:
                return some[0]
        if node.table is None and (found := constant(node.name)) is not None:
            return found
        if self.outer is not None:
            found = self.outer.value(node)
            self.lowering.correlated = True
            return replace(found, col=found.col.outer(), test=None, literal=None)
        full = f"{node.table}.{node.name}" if node.table else node.name
        raise LookupError(f"no such column: {full}")

    def value(self, node: Node) -> Value:
        if node in self.known:
            return self.known[node]
        match node:
            case Literal(value):
                return V.literal(value)
            case Name():
                return self.name(node)
            case Unary("+", operand):
                return replace(self.value(operand), affinity=None, test=None)
            case Unary("-", operand):
                return V.negate(self.value(operand))
            case Unary("~", operand):
                return V.invert(self.value(operand))
            case Unary("NOT", operand):
                return V.condition(~V.truth(self.value(operand)))
            case Binary("AND", a, b):
                return V.condition(V.truth(self.value(a)) & V.truth(self.value(b)))
            case Binary("OR", a, b):
                return V.condition(V.truth(self.value(a)) | V.truth(self.value(b)))
            case Binary("LIKE" | "GLOB" as op, a, b):
                return like(op, self.value(a), self.value(b))
            case Binary("||", a, b):
                return V.concat(self.value(a), self.value(b))
            case Binary("+" | "-" | "*" | "/" | "%" as op, a, b):
                return V.arithmetic(op, self.value(a), self.value(b))
            case Binary("&" | "|" | "<<" | ">>" as op, a, b):
                return V.bits(op, self.value(a), self.value(b))
            case Binary(op, a, b):
                rule = _collation(a) or _collation(b)
                return V.compare(op, collated(self.value(a), rule), collated(self.value(b), rule))
            case Collate(operand):
                return self.value(operand)
            case Scalar(query):
                return self.subquery(query)
            case InQuery(operand, query, negated):
                out, _ = self.lowering.inner(query, self)
                if len(out.names) != 1:
                    raise V.DialectError("sub-select returns more than one column")
                right, item = out.frame.toDF("__in"), _value_of(F.col("__in"), out.kinds[0], None)
                left = self.value(operand)
                same = V.truth(V.compare("=", replace(left, col=left.col.outer(), test=None, literal=None), item))
                found = F.when(right.filter(same).exists(), F.lit(True)).when(~right.filter(same.isNull()).exists(), F.lit(False))
                return V.condition(~found if negated else found)
            case Exists(query):
                out, _ = self.lowering.inner(query, self)
                return V.condition(out.frame.select(F.lit(1).alias("__any")).exists())
            case IsNull(operand, negated):
                v = self.value(operand)
                return V.condition(v.col.isNotNull() if negated else v.col.isNull())
            case InList(operand, items, negated):
                rule = _collation(operand)
                return V.member(collated(self.value(operand), rule), [collated(self.value(x), rule) for x in items], negated)
            case Between(operand, low, high, negated):
                rule = _collation(operand)
                v, a, b = (collated(self.value(x), rule) for x in (operand, low, high))
                test = V.truth(V.compare(">=", v, a)) & V.truth(V.compare("<=", v, b))
                return V.condition(~test if negated else test)
            case Case(base, whens, other):
                b = self.value(base) if base is not None else None
                tests = [V.truth(self.value(w)) if b is None else V.truth(V.compare("=", b, self.value(w))) for w, _ in whens]
                return choose(list(zip(tests, [self.value(t) for _, t in whens], strict=True)), self.value(other) if other is not None else None)
            case Cast(operand, kind):
                return V.cast(self.value(operand), kind)
            case Windowed(call, partition, order, frame):
                spec = self.window(partition, order, by_rows(node))
                if frame:
                    low = Window.unboundedPreceding if frame.low is None else frame.low
                    high = Window.unboundedFollowing if frame.high is None else frame.high
                    if frame.unit == "ROWS":
                        spec = spec.rowsBetween(low, high)
                    elif frame.unit == "RANGE":
                        if isinstance(low, float) or isinstance(high, float):
                            raise V.DialectError("RANGE needs whole numbers")
                        spec = spec.rangeBetween(low, high)
                    else:  # GROUPS: ranges over the numbers of the peers, see Lowering._windows
                        spec = Window.partitionBy(*[self.value(p).col for p in partition]).orderBy(self.known[("peers", partition, order)].col).rangeBetween(low, high)
                args = [] if call.args == (Star(),) else [self.value(a) for a in call.args]
                if call.where is not None:
                    args = where(args, V.truth(self.value(call.where)))
                if ("rows", partition, order) in self.known and by_peers(node):
                    return edge(call.name, args, self.known[("rows", partition, order)].col, spec)
                return windowed(call.name, args, call.distinct, spec)
            case Call(name, (pattern, operand, escape), _) if name.lower() == "like":
                return like("LIKE", self.value(operand), self.value(pattern), self.value(escape))
            case Call(name, args, _):
                if is_aggregate(name, len(args)):
                    raise V.DialectError(f"misuse of aggregate function {name}()")
                return scalar(name, [self.value(a) for a in args])
        raise V.DialectError(f"misuse of {title(node)}")

    def window(self, partition: tuple[Node, ...], order: tuple[Key, ...], total: bool) -> WindowSpec:
        """total: peers stand in storage order, as far as there is one."""
        keys = [*[self.key(k) for k in order], *[F.col(c) for c in self.storage if total]]
        return Window.partitionBy(*[self.value(p).col for p in partition]).orderBy(*keys)

    def key(self, k: Key) -> Column:
        return sort_key(collated(self.value(k.expr), _collation(k.expr)), k.descending, k.nulls_first)

    def subquery(self, query: Select) -> Value:
        """Catalyst plans it as a subquery: run once if it names nothing of this scope, else turned into a join."""
        out, _ = self.lowering.inner(query, self)
        if len(out.names) != 1:
            raise V.DialectError(f"sub-select returns {len(out.names)} columns - expected 1")
        one = query.cores[0]
        alone = len(query.cores) == 1 and not one.group and bool(aggregates(one.items))  # an aggregate has one row
        return Value((out.frame if alone else out.frame.limit(1)).scalar(), out.kinds[0], None)


def _collation(node: Node) -> str | None:
    return node.name if isinstance(node, Collate) else None


@dataclass
class Output:
    frame: DataFrame
    names: list[str]
    kinds: list[str]
    affinities: list[str | None]

    def named(self) -> DataFrame:
        return self.frame.toDF(*self.names) if self.frame.columns != self.names else self.frame


def _conjuncts(node: Node) -> Iterator[Node]:
    if isinstance(node, Binary) and node.op == "AND":
        yield from _conjuncts(node.left)
        yield from _conjuncts(node.right)
    else:
        yield node


def aggregates(node: object) -> list[Call]:
    """Aggregate calls that are no window functions."""
    over = {x.call for x in walk(node) if isinstance(x, Windowed)}
    return [x for x in walk(node) if isinstance(x, Call) and is_aggregate(x.name, len(x.args)) and x not in over]


def by_rows(node: Windowed) -> bool:
    """Whether the result depends on the order of peers through single rows."""
    return node.call.name.lower() in ("row_number", "ntile", "lag", "lead") or node.frame is not None and node.frame.unit == "ROWS"


def by_peers(node: Windowed) -> bool:
    """Whether it does so in a frame that holds peers together."""
    return node.call.name.lower() in ("first_value", "last_value") and not by_rows(node)


def _outside(node: object) -> Iterator[object]:
    """walk(), but not into aggregate calls."""
    if isinstance(node, tuple):
        for x in node:
            yield from _outside(x)
    elif is_dataclass(node) and not (isinstance(node, Call) and is_aggregate(node.name, len(node.args))):
        yield node
        if not isinstance(node, (Select, Source)):
            for f in fields(node):
                yield from _outside(getattr(node, f.name))


class Lowering:
    def __init__(self, catalogue: Catalogue):
        self.catalogue = catalogue
        self.ctes: dict[str, tuple] = {}  # by name: column names, statement, the ones before it
        self.outer: Scope | None = None  # the scope around the subquery in hand
        self.correlated = False  # whether it names something of that scope
        self.base, self.cores = "", 0
        self.only: int | None = None  # how many files of the table to read

    def inner(self, query: Select, scope: Scope) -> tuple[Output, bool]:
        """A subquery of an expression, and whether it is correlated."""
        held, self.outer, self.correlated = (self.outer, self.correlated, self.base), scope, False
        try:
            return self.select(query), self.correlated
        finally:
            self.outer, self.correlated, self.base = held

    def run(self, statement: Select) -> DataFrame:
        return self.select(statement).named()

    def select(self, s: Select) -> Output:
        if s.ctes:
            outer = self.ctes
            try:
                for name, columns, query in s.ctes:
                    self.ctes = {**self.ctes, name.lower(): (columns, query, self.ctes)}
                return self.select(replace(s, ctes=()))
            finally:
                self.ctes = outer
        if len(s.cores) == 1:
            return self.core(s.cores[0], s.order, s.limit, s.offset)
        outs = [self.core(c, (), None, 0) for c in s.cores]
        if len({len(o.names) for o in outs}) > 1:
            raise V.DialectError("SELECTs of a set operation do not have the same number of result columns")
        width = range(len(outs[0].names))
        sides = []
        for o in outs:
            columns = [_value_of(F.col(f"_{i}"), o.kinds[i], o.affinities[i]) for i in width]
            sides.append((o.frame.toDF(*[f"_{i}" for i in width]), columns))
        unified = [V.unify([columns[i] for _, columns in sides]) for i in width]
        frames = [df.select(*[unified[i][k].col.alias(f"_{i}") for i in width]) for k, (df, _) in enumerate(sides)]
        whole = frames[0]
        for op, df in zip(s.operators, frames[1:], strict=True):
            whole = combine(op, whole, df)
        kinds = [next((v.kind for v in u if v.kind != "null"), "null") for u in unified]
        out = Output(whole, outs[0].names, kinds, [None] * len(width))
        return self._finish(out, s.order, s.limit, s.offset)

    def _finish(self, out: Output, order: tuple[Key, ...], limit: int | None, offset: int) -> Output:
        """Sort and cut rows that have no source any more: keys are result columns."""
        plain = out.frame.toDF(*[f"_{i}" for i in range(len(out.names))])
        fields_ = {n.lower(): Field(n, F.col(f"_{i}"), _value_of(F.col(f"_{i}"), out.kinds[i], out.affinities[i])) for i, n in reversed(list(enumerate(out.names)))}
        scope = Scope([Part("", fields_, None)], self)
        keys = [scope.key(replace(k, expr=_ordinal(k.expr, [Item(Name(n)) for n in out.names]))) for k in order]
        plain = cut(ordered(plain, keys, ()), limit, offset)
        return replace(out, frame=plain)

    def _source(self, source: Source, number: int | None, wants_rowid: bool, wants_order: bool) -> tuple[DataFrame, Part, tuple[str, ...]]:
        """The source's frame, its names, and the columns of its storage order. number: in a join, to keep names apart."""
        named = self.ctes.get(source.table.lower()) if isinstance(source.table, str) else None
        if named or isinstance(source.table, Select):
            if named:
                columns, query, before = named
                here, self.ctes = self.ctes, before  # a statement sees those before it
                inner = self.select(query)
                self.ctes = here
                if columns:
                    if len(columns) != len(inner.names):
                        raise V.DialectError(f"table {source.table} has {len(inner.names)} values for {len(columns)} columns")
                    inner = replace(inner, names=list(columns))
                source = Source(query, source.alias or source.table)
            else:
                inner = self.select(source.table)
            df = inner.frame.toDF(*[f"_{i}" for i in range(len(inner.names))])
            own = {n.lower(): (n, F.col(f"_{i}"), inner.kinds[i], inner.affinities[i]) for i, n in reversed(list(enumerate(inner.names)))}
            own = dict(reversed(own.items()))
            rowid, storage, alias = None, (), source.alias or f"(subquery {number or 0})"
        else:
            table = self.catalogue.get(source.table)
            alias = source.alias or source.table
            wants_rowid = wants_rowid and table.numbered is not None
            storage = ()
            if wants_rowid:
                df, storage = table.numbered(), (ROWID,)
            elif wants_order and table.ordered is not None:
                df, storage = table.ordered() if self.only is None else table.part(self.only), table.order
            else:
                df = table.frame()
            own = {c.lower(): (c, _quoted(c), table.kinds[c], table.affinities[c]) for c in table.columns}
            rowid = Value(F.col(ROWID), "int", "integer") if wants_rowid else None
        if number is not None or self.base:
            tag = f"{self.base}t{number or 0}"
            names = {key: f"{tag}_{i}" for i, key in enumerate(own)}
            kept = {*storage, *([ROWID] if rowid else [])}
            df = df.select(*[raw.alias(names[key]) for key, (_, raw, _, _) in own.items()], *[F.col(c).alias(f"{tag}{c}") for c in kept])
            df = df.alias(tag)  # names that are not of this table must not be looked for below the renaming
            own = {key: (n, F.col(names[key]), kind, affinity) for key, (n, _, kind, affinity) in own.items()}
            rowid = replace(rowid, col=F.col(f"{tag}{ROWID}")) if rowid else None
            storage = tuple(f"{tag}{c}" for c in storage) if number is None else ()
        columns = {key: Field(n, raw, _value_of(raw, kind, affinity)) for key, (n, raw, kind, affinity) in own.items()}
        return df, Part(alias.lower(), columns, rowid), storage

    def _from(self, core: Core, order: tuple[Key, ...], wants_order: bool) -> tuple[DataFrame, Scope, tuple[str, ...]]:
        named = {x.name.lower() for x in walk((core.items, core.where or (), core.group, core.having or (), order, core.joins)) if isinstance(x, Name)}
        wants_rowid = bool(named & set(ROWID_NAMES))
        if core.source is None:
            return self.catalogue.spark.range(1), Scope([], self), ()
        if not core.joins:
            df, part, storage = self._source(core.source, None, wants_rowid, wants_order)
            return df, Scope([part], self), storage
        df, part, _ = self._source(core.source, 0, wants_rowid, False)
        scope = Scope([part], self)
        for i, join in enumerate(core.joins, 1):
            df, scope = self._join(df, scope, join, i, wants_rowid)
        return df, scope, ()

    def _join(self, df: DataFrame, scope: Scope, join: Join, number: int, wants_rowid: bool) -> tuple[DataFrame, Scope]:
        right, part, _ = self._source(join.source, number, wants_rowid, False)
        using = join.using
        if join.natural:
            left = [k for p in scope.parts for k, f in p.columns.items() if not f.hidden]
            using = tuple(k for k in part.columns if k in left)
        test: Column | None = None
        for name in using:
            a, b = scope.column(Name(name)), part.columns.get(name.lower())
            if a is None or b is None:
                raise LookupError(f"cannot join using column {name} - column not present in both tables")
            same = V.truth(V.compare("=", a.value, b.value))
            test = same if test is None else test & same
            if join.kind in ("right", "full"):
                both = V.unify([a.value, b.value])
                merged = F.coalesce(both[0].col, both[1].col)
                a.raw, a.value = merged, replace(a.value, col=merged, kind=both[0].kind)
            b.hidden = True
        scope = Scope([*scope.parts, part], self)
        if join.on is not None:
            test = V.truth(scope.value(join.on))
        how = join.kind if join.kind != "cross" else "inner"
        if test is None:
            return df.crossJoin(right) if how == "inner" else df.join(right, F.lit(True), how), scope
        return df.join(right, test, how), scope

    def core(self, core: Core, order: tuple[Key, ...], limit: int | None, offset: int) -> Output:
        if core.values:
            return self._finish(self._values(core.values), order, limit, offset)
        if self.outer is not None:
            self.cores += 1
            self.base = f"q{self.cores}"
        grouped = bool(core.group) or core.having is not None or bool(aggregates((core.items, order)))
        plain = not grouped and not core.distinct
        if plain and not order and limit is not None:
            self.only = self._first(core, limit + offset)
        try:
            ties = not grouped and any(isinstance(x, Windowed) and (by_rows(x) or by_peers(x)) for x in walk((core.items, order)))
            df, scope, storage = self._from(core, order, self.only is not None or ties or plain and (bool(order) or limit is not None or offset > 0))
            scope.storage = () if grouped else storage
        finally:
            self.only = None
        items = self._items(core.items, scope)
        scope.aliases = {i.alias.lower(): i.expr for i in reversed(items) if i.alias}
        for test in _conjuncts(core.where) if core.where is not None else ():
            df = self._where(df, scope, test)
        if grouped:
            df = self._group(df, scope, core, items, order)
            if core.having is not None:
                df = df.filter(V.truth(scope.value(core.having)))
        df = self._ahead(df, scope, items, order)
        if not core.distinct:
            keys = [scope.key(replace(k, expr=_ordinal(k.expr, items))) for k in order]
            if keys or limit is not None or offset:
                df = ordered(df, keys, () if grouped else storage)
            df = cut(df, limit, offset)
        names, columns, kinds, affinities = [], [], [], []
        for item in items:
            field = scope.column(item.expr) if isinstance(item.expr, Name) and item.expr not in scope.known else None
            value = field.value if field else scope.value(item.expr)
            raw = field.raw if field else value.col.cast("int") if value.kind == "null" else value.col
            names.append(item.alias or title(item.expr))
            columns.append(raw.alias(names[-1]))
            kinds.append(value.kind)
            affinities.append(value.affinity)
        out = Output(df.select(*columns), names, kinds, affinities)
        if core.distinct:
            out = replace(out, frame=out.frame.distinct())
            return self._finish(out, order, limit, offset) if order or limit is not None or offset else out
        return out

    def _first(self, core: Core, wanted: int) -> int | None:
        """How many files of the statement's table, in storage order, have as many of its rows as are wanted; None: all, or it does not matter. One file, then
        four, sixteen and so on are read, each only until it has given enough rows."""
        if core.source is None or core.joins or not isinstance(core.source.table, str) or core.source.table.lower() in self.ctes or self.outer is not None:
            return None
        if any(isinstance(x, (Windowed, Scalar, Exists, InQuery)) or isinstance(x, Name) and x.name.lower() in ROWID_NAMES for x in walk((core.items, core.where or ()))):
            return None
        files = self.catalogue.get(core.source.table).files()
        k = 1
        while k < len(files):
            self.only = k
            try:
                if self.core(core, (), None, 0).frame.limit(wanted).count() >= wanted:
                    return k
            finally:
                self.only = None
            k *= 4
        return None

    def _values(self, rows: tuple[tuple[Node, ...], ...]) -> Output:
        scope = Scope([], self)
        columns = [V.unify([scope.value(x) for x in column]) for column in zip(*rows, strict=True)]
        kinds = [next((v.kind for v in c if v.kind != "null"), "null") for c in columns]
        cols = [[v.col.cast("int") if k == "null" else v.col for v in c] for c, k in zip(columns, kinds, strict=True)]
        structs = [F.struct(*[c[i].alias(f"_{j}") for j, c in enumerate(cols)]) for i in range(len(rows))]
        frame = self.catalogue.spark.range(1).select(F.inline(F.array(*structs)))
        names = [f"column{j + 1}" for j in range(len(columns))]
        return Output(frame.toDF(*names), names, kinds, [None] * len(names))

    def _ahead(self, df: DataFrame, scope: Scope, items: list[Item], order: tuple[Key, ...]) -> DataFrame:
        """Subqueries and window functions become columns here: windows see every row before sorting and cutting, and the joins that
        correlated subqueries turn into come before the sort."""
        nodes = list(dict.fromkeys(walk((tuple(items), order))))
        for kinds in ((Scalar, Exists, InQuery), (Windowed,)):
            for node in nodes:
                if not isinstance(node, kinds):
                    continue
                if isinstance(node, Windowed) and node.frame and node.frame.unit == "GROUPS":
                    spec = scope.window(node.partition, node.order, False)
                    df = self._named(df, scope, ("peers", node.partition, node.order), Value(F.dense_rank().over(spec).cast("long"), "int"))
                if isinstance(node, Windowed) and by_peers(node) and scope.storage:
                    spec = scope.window(node.partition, node.order, True)
                    df = self._named(df, scope, ("rows", node.partition, node.order), Value(F.row_number().over(spec).cast("long"), "int"))
                df = self._named(df, scope, node, scope.value(node))
        return df

    @staticmethod
    def _named(df: DataFrame, scope: Scope, node: object, value: Value) -> DataFrame:
        if node in scope.known:
            return df
        name = f"{scope.base}__x{len(scope.known)}"
        scope.known[node] = replace(value, col=F.col(name), test=None, literal=None, simple=True)
        return df.withColumn(name, value.col)

    def _where(self, df: DataFrame, scope: Scope, test: Node) -> DataFrame:
        """One condition of WHERE's conjunction; a subquery there is a semi or anti join."""
        negated = isinstance(test, Unary) and test.op == "NOT" and isinstance(test.operand, (InQuery, Exists))
        inner = test.operand if negated else test
        if not isinstance(inner, InQuery):
            return df.filter(V.truth(scope.value(test)))
        out, correlated = self.inner(inner.query, scope)
        if len(out.names) != 1:
            raise V.DialectError("sub-select returns more than one column")
        right = out.frame.toDF("__in")
        left, item = scope.value(inner.operand), _value_of(F.col("__in"), out.kinds[0], None)
        if correlated:  # IN: there is an equal one; NOT IN: there is none that is equal or may be, for NULLs
            around = replace(left, col=left.col.outer(), test=None, literal=None)
            same = V.truth(V.compare("=", around, item))
            none = negated ^ inner.negated
            found = right.filter(F.coalesce(same, F.lit(True)) if none else same).exists()
            return df.filter(~found if none else found)
        same = V.truth(V.compare("=", left, item))
        if not (negated ^ inner.negated):
            return df.join(right, same, "left_semi")
        # NOT IN: nothing if the list has a NULL, and a NULL on the left only passes an empty list
        holes = right.agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col("__in").isNull(), 1)).alias("__null"))
        kept = df.join(right, same, "left_anti").join(F.broadcast(holes), F.lit(True))  # one row
        return kept.filter((F.col("__n") == 0) | (left.col.isNotNull() & (F.col("__null") == 0))).drop("__n", "__null")

    def _items(self, items: tuple[Item, ...], scope: Scope) -> list[Item]:
        out = []
        for item in items:
            if not isinstance(item.expr, Star):
                out.append(item)
                continue
            parts = [p for p in scope.parts if item.expr.table is None or p.alias == item.expr.table.lower()]
            if not parts and scope.parts:
                raise LookupError(f"no such table: {item.expr.table}")
            if not scope.parts:
                raise V.DialectError("no tables specified")
            several = len(scope.parts) > 1
            out += [Item(Name(f.name, p.alias if several else None), f.name) for p in parts for f in p.columns.values() if not f.hidden]
        return out

    def _group(self, df: DataFrame, scope: Scope, core: Core, items: list[Item], order: tuple[Key, ...]) -> DataFrame:
        keys = [_ordinal(g, items) for g in core.group]
        key_values = [scope.value(k) for k in keys]
        calls = list(dict.fromkeys(aggregates((tuple(items), core.having or (), order, tuple(scope.aliases.values())))))
        found = []
        for c in calls:
            args = [] if c.args in ((), (Star(),)) else [scope.value(a) for a in c.args]
            found.append(aggregate(c.name, where(args, V.truth(scope.value(c.where))) if c.where is not None else args, c.distinct))
        # a column that is neither grouped nor aggregated takes the value of some row of the group, that of the one min() or max() if there is one
        bare = [x for x in dict.fromkeys(_outside((tuple(items), core.having or (), order))) if isinstance(x, Name) and x not in keys and scope.column(x)]
        bare_values = [scope.value(b) for b in bare]
        extremes = [c for c in calls if c.name.lower() in ("min", "max")]
        pick = F.first
        if len(extremes) == 1 and extremes[0].where is None:
            by, best = V.sort_column(scope.value(extremes[0].args[0])), F.min_by if extremes[0].name.lower() == "min" else F.max_by
            pick = lambda col: F.when(F.count(by) > 0, best(col, by)).otherwise(F.first(col))
        columns = [v.col.alias(f"{scope.base}__a{i}") for i, v in enumerate([*found, *[replace(v, col=pick(v.col)) for v in bare_values]])]
        by = [v.col.alias(f"{scope.base}__k{i}") for i, v in enumerate(key_values)]
        df = df.select(*by).distinct() if not columns else df.groupBy(*by).agg(*columns) if by else df.select(*columns)
        for i, (k, v) in enumerate(zip(keys, key_values, strict=True)):
            scope.known[k] = replace(v, col=F.col(f"{scope.base}__k{i}"), test=None, literal=None)
        for i, (c, v) in enumerate(zip([*calls, *bare], [*found, *bare_values], strict=True)):
            scope.known[c] = replace(v, col=F.col(f"{scope.base}__a{i}"), test=None, literal=None)
        return df


def _ordinal(node: Node, items: list[Item]) -> Node:
    """ORDER BY 2 and GROUP BY 2 mean the second result column."""
    if isinstance(node, Literal) and isinstance(node.value, int):
        if not 1 <= node.value <= len(items):
            raise V.DialectError(f"term out of range: {node.value}")
        return items[node.value - 1].expr
    return node


