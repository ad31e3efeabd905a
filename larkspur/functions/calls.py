"""Functions by name. typeof is the dialect's own; the others are extensions after SQLite's documentation."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .values import (
    DialectError, Value, _as_numeric, _either, _field, _numbers, class_name, compare, condition, literal, sort_column, text, truth, unify,
)

AGGREGATES = {"count", "sum", "total", "avg", "min", "max", "group_concat"}


def is_aggregate(name: str, args: int) -> bool:
    return name.lower() in AGGREGATES and not (name.lower() in ("min", "max") and args > 1)


def _first_known(values: list[Value]) -> Value:
    same = unify(values)
    return Value(F.coalesce(*[v.col for v in same]), same[-1].kind if any(v.kind != "null" for v in same) else "null")


def choose(whens: list[tuple[Column, Value]], other: Value | None) -> Value:
    values = unify([*[v for _, v in whens], other or literal(None)])
    kind = next((v.kind for v in values if v.kind != "null"), "null")
    col: Column | None = None
    for (test, _), v in zip(whens, values, strict=False):
        col = F.when(test, v.col) if col is None else col.when(test, v.col)
    return Value(col.otherwise(values[-1].col), kind)


def _extreme(values: list[Value], op: str) -> Value:
    out = unify(values)
    best = out[0]
    for v in out[1:]:
        first = F.when(best.col.isNull() | v.col.isNull(), F.lit(None)).when(truth(compare(op, best, v)), best.col)
        best = Value(first.otherwise(v.col), v.kind)
    return best


_TIMES = {"CURRENT_DATE": "yyyy-MM-dd", "CURRENT_TIME": "HH:mm:ss", "CURRENT_TIMESTAMP": "yyyy-MM-dd HH:mm:ss"}


def constant(name: str) -> Value | None:
    """Names that are values where no column has them; times are in UTC."""
    if name.upper() in ("TRUE", "FALSE"):
        return literal(int(name.upper() == "TRUE"))
    if name.upper() in _TIMES:
        now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
        return Value(F.date_format(now, _TIMES[name.upper()]), "text")
    return None


def scalar(name: str, args: list[Value]) -> Value:
    n = name.lower()

    def need(*counts: int) -> None:
        if len(args) not in counts:
            raise DialectError(f"wrong number of arguments to function {name}()")

    if n == "typeof":
        need(1)
        return Value(class_name(args[0]), "text")
    if n in ("coalesce", "ifnull"):
        need(2) if n == "ifnull" else None
        return _first_known(args)
    if n == "nullif":
        need(2)
        return Value(F.when(F.coalesce(compare("=", *args).test, F.lit(False)), F.lit(None)).otherwise(args[0].col), args[0].kind)
    if n == "iif":
        need(2, 3)
        return choose([(truth(args[0]), args[1])], args[2] if len(args) > 2 else None)
    if n in ("min", "max"):
        return _extreme(args, "<=" if n == "min" else ">=")
    if n == "abs":
        need(1)
        whole, i, d = _numbers(args[0])
        return _either(whole, F.abs(i), F.abs(d))
    if n == "length":
        need(1)
        v = args[0]
        return Value((F.octet_length(v.col) if v.kind == "blob" else F.length(text(v))).cast("long"), "int")
    if n in ("lower", "upper"):
        need(1)
        return Value(F.translate(text(args[0]), *((_HIGH, _LOW) if n == "lower" else (_LOW, _HIGH))), "text")
    if n == "hex":
        need(1)
        v = args[0]
        raw = v.col if v.kind == "blob" else _field(v, "b") if v.kind == "mixed" else None
        shown = text(v).cast("binary")
        return Value(F.coalesce(F.hex(F.coalesce(raw, shown) if raw is not None else shown), F.lit("")), "text")
    if n == "unicode":
        need(1)
        first = F.substr(text(args[0]), F.lit(1), F.lit(1))
        # four bytes of UTF-32 are the number
        return Value(F.when(first != "", F.conv(F.hex(F.encode(first, "UTF-32")), 16, 10).cast("long")), "int")
    if n == "sign":
        need(1)
        v = args[0]
        whole, i, d = _numbers(_as_numeric(v) if v.kind in ("text", "mixed") else v)
        known = class_name(_as_numeric(v) if v.kind in ("text", "mixed") else v).isin("integer", "real")
        return Value(F.when(known, F.signum(d).cast("long")), "int")
    if n in ("trim", "ltrim", "rtrim"):
        need(1, 2)
        return Value(getattr(F, n)(text(args[0]), text(args[1]) if len(args) > 1 else F.lit(" ")), "text")
    if n == "replace":
        need(3)
        a, b, c = map(text, args)
        return Value(F.when(b == "", a).otherwise(F.replace(a, b, c)), "text")
    if n == "instr":
        need(2)
        return Value(F.call_function("locate", text(args[1]), text(args[0])).cast("long"), "int")
    if n in ("substr", "substring"):
        need(2, 3)
        start = _numbers(args[1])[1].cast("int")
        size = _numbers(args[2])[1].cast("int") if len(args) > 2 else F.lit((1 << 31) - 1)
        return Value(F.substr(text(args[0]), start, size), "text")
    if n == "round":
        need(1, 2)
        places = args[1].literal if len(args) > 1 else 0
        return Value(F.round(_numbers(args[0])[2], places), "real")
    raise DialectError(f"no such function: {name}")


def aggregate(name: str, args: list[Value], distinct: bool) -> Value:
    """count() without arguments counts rows."""
    n = name.lower()
    if n == "count":
        if not args:
            return Value(F.count(F.lit(1)), "int")
        return Value(F.count_distinct(args[0].col) if distinct else F.count(args[0].col), "int")
    if len(args) != 1 and n != "group_concat":
        raise DialectError(f"wrong number of arguments to function {name}()")
    v = args[0]
    if n in ("min", "max"):
        key = sort_column(v)
        return Value(getattr(F, f"{n}_by")(v.col, key) if v.kind == "mixed" else getattr(F, n)(v.col), v.kind, v.affinity)
    if n == "group_concat":
        parts = F.collect_set(text(v)) if distinct else F.collect_list(text(v))
        glue = args[1].literal if len(args) > 1 else ","
        return Value(F.when(F.size(parts) > 0, F.concat_ws(str(glue), F.array_sort(parts))), "text")
    whole, i, d = _numbers(v)
    over = (lambda c: F.sum_distinct(c)) if distinct else F.sum
    if n == "sum":
        if whole is True:
            return Value(over(i), "int")
        return Value(over(d), "real")
    if n == "total":
        return Value(F.coalesce(over(d), F.lit(0.0)), "real")
    return Value(F.avg(d) if not distinct else F.sum_distinct(d) / F.count_distinct(d), "real")


_LOW, _HIGH = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def collated(v: Value, rule: str | None) -> Value:
    """v as the collation compares it: text only."""
    if rule in (None, "BINARY") or v.kind != "text":
        return v
    if rule == "RTRIM":
        return replace(v, col=F.rtrim(v.col, F.lit(" ")), literal=None if v.literal is None else v.literal.rstrip(" "), simple=False)
    lower = None if v.literal is None else v.literal.translate(str.maketrans(_HIGH, _LOW))
    return replace(v, col=F.translate(v.col, _HIGH, _LOW), literal=lower, simple=False)


def where(args: list[Value], test: Column) -> list[Value]:
    """An aggregate's arguments under FILTER; a row that fails the test counts as NULL. count(*) counts ones."""
    return [replace(v, col=F.when(test, v.col), test=None, literal=None, simple=False) for v in args or [literal(1)]]


def like(op: str, v: Value, pattern: Value, escape: Value | None = None) -> Value:
    """LIKE: % and _, ASCII letters in either case. GLOB: * ? [set], exact."""
    mark = None
    if escape is not None:
        mark = escape.literal
        if not isinstance(mark, str) or len(mark) != 1:
            raise DialectError("ESCAPE expression must be a single character")
    if not isinstance(pattern.literal, str):
        if op == "GLOB" or mark:
            raise DialectError(f"{'GLOB' if op == 'GLOB' else 'ESCAPE'} needs a literal pattern")
        low = [F.translate(text(x), _HIGH, _LOW) for x in (v, pattern)]
        return condition(F.like(low[0], F.replace(low[1], F.lit("\\"), F.lit("\\\\"))))
    p, out = pattern.literal, ""
    if op == "LIKE":
        plain = False
        for c in p:
            if c == mark and not plain:
                plain = True
                continue
            out += (None if plain else {"%": ".*", "_": "."}.get(c)) or (re.escape(c) if c.isascii() else c)
            plain = False
        return condition(F.regexp_like(text(v), F.lit(f"(?is)\\A{out}\\z")))
    i = 0
    while i < len(p):
        c = p[i]
        end = p.find("]", i + 2)
        if c == "[" and end > 0:
            body = p[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = f"{out}[{body}]", end
        else:
            out += {"*": ".*", "?": "."}.get(c) or (re.escape(c) if c.isascii() else c)
        i += 1
    return condition(F.regexp_like(text(v), F.lit(f"(?s)\\A{out}\\z")))


def edge(name: str, args: list[Value], number: Column, spec: WindowSpec) -> Value:
    """first_value or last_value over a window whose rows have numbers that also tell peers apart."""
    pick = F.min_by if name.lower() == "first_value" else F.max_by
    return Value(pick(args[0].col, number).over(spec), args[0].kind, args[0].affinity)


def windowed(name: str, args: list[Value], distinct: bool, spec: WindowSpec) -> Value:
    """A ranking, offset or aggregate function over a window."""
    n = name.lower()
    ranks = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
    if n in ranks:
        return Value(ranks[n]().over(spec).cast("long"), "int")
    if n == "ntile":
        return Value(F.ntile(args[0].literal).over(spec).cast("long"), "int")
    if n in ("percent_rank", "cume_dist"):
        return Value(getattr(F, n)().over(spec), "real")
    if n in ("lag", "lead"):
        v, step = args[0], args[1].literal if len(args) > 1 else 1
        return Value(getattr(F, n)(v.col, step, args[2].literal if len(args) > 2 else None).over(spec), v.kind, v.affinity)
    if n in ("first_value", "last_value"):
        return Value(getattr(F, n)(args[0].col).over(spec), args[0].kind, args[0].affinity)
    if n not in ("count", "sum", "avg", "min", "max") or distinct or any(a.kind == "mixed" for a in args):
        raise DialectError(f"no such window function: {name}")
    found = aggregate(name, args, False)
    return Value(found.col.over(spec), found.kind, found.affinity)
