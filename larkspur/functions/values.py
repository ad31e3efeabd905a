"""Values of the dialect as Spark columns.

A value is NULL, INTEGER, REAL, TEXT or BLOB. An expression whose class is known when the statement is planned is a
plain column; one whose class varies by row is a struct (MIXED) that sorts as the dialect does: NULL, numbers, text,
blobs. A column's declared type gives it an affinity, which decides how it is compared.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIXED = T.StructType([
    T.StructField("cls", T.ByteType()), T.StructField("num", T.DoubleType()), T.StructField("i", T.LongType()),
    T.StructField("t", T.StringType()), T.StructField("b", T.BinaryType()),
])
_MIXED = MIXED.simpleString()
NUMBER, TEXT, BLOB = 1, 2, 3
_CLASS = {"int": NUMBER, "real": NUMBER, "text": TEXT, "blob": BLOB}
_NUMERIC = ("integer", "real", "numeric")
#: A whole number literal in text, with the spaces that may surround it.
_WHOLE = r"^[ \t\n\x0B\f\r]*[+-]?[0-9]+[ \t\n\x0B\f\r]*$"
_REAL = r"^[ \t\n\x0B\f\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\x0B\f\r]*$"
_PREFIX = r"^[ \t\n\x0B\f\r]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"
_START = r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)"
_BLANKS = " \t\n\x0b\f\r"


class DialectError(ValueError):
    """An expression that the dialect has no meaning for."""


def affinity_of(declared: str | None) -> str:
    """The affinity that a declared type gives."""
    kind = (declared or "").upper()
    if "INT" in kind:
        return "integer"
    if any(x in kind for x in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if not kind or "BLOB" in kind:
        return "blob"
    return "real" if any(x in kind for x in ("REAL", "FLOA", "DOUB")) else "numeric"


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str  # null int real text blob mixed other
    affinity: str | None = None  # None: no column's
    test: Column | None = None  # as a condition, where the value is one
    literal: object = None
    simple: bool = False  # a column or a literal: cheap to name more than once


def bound(f: Callable) -> Callable:
    """f, but an operand that is a long expression of no fixed class is computed once and named: f uses its operands
    several times, and nested calls would grow without bound. (A lambda over an array of one struct names it.)"""

    @functools.wraps(f)
    def run(*args):
        heavy = [i for i, a in enumerate(args) if isinstance(a, Value) and a.kind in ("mixed", "text", "blob") and not a.simple]
        if not heavy:
            return f(*args)
        found: list = []

        def body(s: Column) -> Column:
            own = list(args)
            for i in heavy:
                own[i] = replace(args[i], col=s.getField(f"v{i}"), simple=True)
            found.append(f(*own))
            return found[0].col if isinstance(found[0], Value) else found[0]

        col = F.get(F.transform(F.array(F.struct(*[args[i].col.alias(f"v{i}") for i in heavy])), body), F.lit(0))
        if not isinstance(found[0], Value):
            return col
        return replace(found[0], col=col, test=None if found[0].test is None else col != 0, simple=False)

    return run


def literal(value: object) -> Value:
    if value is None:
        return Value(F.lit(None), "null", simple=True)
    if isinstance(value, bool):
        raise TypeError(value)
    if isinstance(value, int):
        return Value(F.lit(value).cast("long"), "int", literal=value, simple=True)
    if isinstance(value, float):
        return Value(F.lit(value).cast("double"), "real", literal=value, simple=True)
    if isinstance(value, bytes):
        return Value(F.lit(value), "blob", literal=value, simple=True)
    return Value(F.lit(value), "text", literal=value, simple=True)


def condition(test: Column) -> Value:
    return Value(test.cast("long"), "int", test=test)


def real_text(v: float) -> str:
    """A REAL as the dialect prints it."""
    if v != v:
        return ""
    if v in (float("inf"), float("-inf")):
        return "Inf" if v > 0 else "-Inf"
    out = "%.15g" % (v + 0.0 if v else 0.0)
    if "e" in out:
        mantissa, _, power = out.partition("e")
        return f"{mantissa if '.' in mantissa else mantissa + '.0'}e{power}"
    return out if "." in out else out + ".0"


def _real_texts(v: Column) -> Column:
    """real_text() in SQL functions: 15 significant digits, laid out by their exponent."""
    shown = F.format_string("%.14e", v)
    digits = F.rtrim(F.concat(F.regexp_extract(shown, r"(\d)\.", 1), F.regexp_extract(shown, r"\.(\d+)e", 1)), F.lit("0"))
    power = F.regexp_extract(shown, r"e([+-]\d+)$", 1).try_cast("int")
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    tail = lambda c: F.when(c == "", F.lit("0")).otherwise(c)
    large = F.concat(F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."), tail(F.substr(digits, power + 2)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    mark = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    wide = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), tail(F.substr(digits, F.lit(2))), mark, F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    layout = F.when((power < -4) | (power >= 15), wide).when(power < 0, small).otherwise(large)
    inf = float("inf")
    return F.when(v == 0, F.lit("0.0")).when(v == inf, F.lit("Inf")).when(v == -inf, F.lit("-Inf")).otherwise(F.concat(sign, layout))


def _field(v: Value, name: str) -> Column:
    return v.col.getField(name)


@bound
def mixed(v: Value) -> Column:
    """v as a MIXED struct; null if it is NULL."""
    if v.kind == "mixed":
        return v.col
    if v.kind == "null":
        return F.lit(None).cast(MIXED)
    none = {"num": F.lit(None).cast("double"), "i": F.lit(None).cast("long"), "t": F.lit(None).cast("string"), "b": F.lit(None).cast("binary")}
    own = {
        "int": {"num": v.col.cast("double"), "i": v.col.cast("long")}, "real": {"num": v.col}, "text": {"t": v.col}, "blob": {"b": v.col},
    }.get(v.kind)
    if own is None:
        raise DialectError("this column's type takes no part in expressions")
    fields = {"cls": F.lit(_CLASS[v.kind]).cast("tinyint"), **none, **own}
    return F.when(v.col.isNotNull(), F.struct(*[c.alias(k) for k, c in fields.items()])).cast(MIXED)


@bound
def text(v: Value) -> Column:
    """v as text; null if it is NULL."""
    match v.kind:
        case "null":
            return F.lit(None).cast("string")
        case "int":
            return v.col.cast("string")
        case "real":
            return F.lit(real_text(v.literal)) if v.literal is not None else _real_texts(v.col)
        case "text":
            return v.col
        case "blob":
            return v.col.cast("string")
        case "mixed":
            return F.coalesce(_field(v, "t"), _field(v, "b").cast("string"), _field(v, "i").cast("string"), _real_texts(_field(v, "num")))
    raise DialectError("this column's type has no text")


def _number_of_text(t: Column) -> tuple[Column, Column, Column]:
    """(is the longest numeric prefix a whole number, the longest whole prefix, the longest prefix as a double); none counts as 0."""
    prefix, start = F.regexp_extract(t, _PREFIX, 1), F.regexp_extract(t, _START, 1)
    i = F.when(start == "", F.lit(0).cast("long")).otherwise(start.try_cast("long"))
    d = F.when(prefix == "", F.lit(0.0)).otherwise(prefix.try_cast("double"))
    return (prefix == start) & i.isNotNull(), F.coalesce(i, _whole(d)), d


def _whole(d: Column) -> Column:
    """A REAL as an INTEGER: towards zero, what leaves 64 bits becomes the nearest that does not."""
    return F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))


def _numbers(v: Value) -> tuple[bool | Column, Column, Column]:
    """(is it a whole number, as long, as double), null where v is NULL."""
    match v.kind:
        case "null":
            return True, F.lit(None).cast("long"), F.lit(None).cast("double")
        case "int":
            return True, v.col.cast("long"), v.col.cast("double")
        case "real":
            return False, _whole(v.col), v.col
        case "text" | "blob":
            if isinstance(v.literal, str):
                m, n = re.match(_PREFIX, v.literal), re.match(_START, v.literal)
                start, d = int(n[1]) if n else 0, float(m[1]) if m else 0.0
                fits = abs(start) < 1 << 63
                whole = fits and (not m or bool(n) and n[1] == m[1])
                return whole, F.lit(start if fits else None).cast("long"), F.lit(d)
            whole, i, d = _number_of_text(text(v))
            known = v.col.isNotNull()
            return whole, F.when(known, i), F.when(known, d)
        case "mixed":
            whole, i, d = _number_of_text(F.coalesce(_field(v, "t"), _field(v, "b").cast("string"), F.lit("")))
            is_number = _field(v, "cls") == NUMBER
            known = v.col.isNotNull()
            return (
                F.when(is_number, _field(v, "i").isNotNull()).otherwise(whole),
                F.when(known, F.when(is_number, F.coalesce(_field(v, "i"), _whole(_field(v, "num")))).otherwise(i)),
                F.when(known, F.when(is_number, _field(v, "num")).otherwise(d)),
            )
    raise DialectError("this column's type is no number")


def _either(whole: bool | Column, i: Column, d: Column) -> Value:
    """A number whose class is known only by row."""
    if whole is True:
        return Value(i, "int")
    if whole is False:
        return Value(d, "real")
    none = F.lit(None)
    number = F.struct(F.lit(NUMBER).cast("tinyint").alias("cls"), F.when(whole, i.cast("double")).otherwise(d).alias("num"), F.when(whole, i).alias("i"), none.cast("string").alias("t"), none.cast("binary").alias("b"))
    return Value(F.when(F.coalesce(i.cast("double"), d).isNotNull(), number).cast(MIXED), "mixed")


def _both(a: bool | Column, b: bool | Column) -> bool | Column:
    if a is False or b is False:
        return False
    if a is True:
        return b
    return a if b is True else a & b


_I64 = float(1 << 63)


@bound
def arithmetic(op: str, a: Value, b: Value) -> Value:
    """+ - * / %. Whole numbers whose result overflows raise; a real operand makes it REAL."""
    if a.kind == "null" or b.kind == "null":
        return Value(F.lit(None).cast("long"), "int")
    (wa, ia, da), (wb, ib, db) = _numbers(a), _numbers(b)
    whole = _both(wa, wb)
    safe = (lambda x: x) if whole is True or whole is False else (lambda x: F.when(whole, x))  # an unused branch must not raise
    ia, ib = safe(ia), safe(ib)
    if op in "+-*":
        apply = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op]
        return _either(whole, apply(ia, ib) if whole is not False else ia, apply(da, db))
    if op == "/":
        nonzero = F.nullif(ib, F.lit(0).cast("long"))
        return _either(whole, F.call_function("div", ia, nonzero) if whole is not False else ia, da / F.nullif(db, F.lit(0.0)))
    (_, ia, _), (_, ib, _) = _numbers(a), _numbers(b)  # both sides as whole numbers
    rest = ia % F.nullif(ib, F.lit(0).cast("long"))
    return _either(whole, rest, rest.cast("double"))


@bound
def bits(op: str, a: Value, b: Value) -> Value:
    (_, x, _), (_, y, _) = _numbers(a), _numbers(b)
    if op == "&":
        return Value(x.bitwiseAND(y), "int")
    if op == "|":
        return Value(x.bitwiseOR(y), "int")
    left = lambda n: F.when(n >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", x, n.cast("int")))
    right = lambda n: F.call_function("shiftright", x, F.least(n, F.lit(63).cast("long")).cast("int"))
    toward, away = (left, right) if op == "<<" else (right, left)
    return Value(F.when(y >= 0, toward(y)).otherwise(away(-y)), "int")


@bound
def negate(v: Value) -> Value:
    if v.literal is not None and v.kind in ("int", "real"):
        return literal(-v.literal)
    if v.kind == "null":
        return v
    whole, i, d = _numbers(v)
    return _either(whole, -i if whole is True or whole is False else F.when(whole, -i), -d)


def invert(v: Value) -> Value:
    return Value(F.bitwise_not(_numbers(v)[1]), "int")


def _constant_text(v: Value) -> str | None:
    if v.literal is None or v.kind == "blob":
        return None
    return real_text(v.literal) if v.kind == "real" else str(v.literal)


def concat(a: Value, b: Value) -> Value:
    x, y = _constant_text(a), _constant_text(b)
    if x is not None and y is not None:
        return literal(x + y)
    return Value(F.concat(text(a), text(b)), "text")


@bound
def truth(v: Value) -> Column:
    """v as a condition: null if it is NULL."""
    if v.test is not None:
        return v.test
    if v.kind == "null":
        return F.lit(None).cast("boolean")
    whole, i, d = _numbers(v)
    if whole is True:
        return i != 0
    return d != 0.0


def _as_numeric(v: Value) -> Value:
    """Text that reads as a number in full becomes one."""
    if v.kind == "text" and v.literal is not None:
        s = v.literal.strip(_BLANKS)
        if re.fullmatch("[+-]?[0-9]+", s) and abs(int(s)) < 1 << 63:
            return literal(int(s))
        return literal(float(s)) if re.match(_REAL, v.literal) else v
    if v.kind not in ("text", "mixed"):
        return v
    t = v.col if v.kind == "text" else _field(v, "t")
    trimmed = F.trim(t, F.lit(_BLANKS))
    i = F.when(F.regexp_like(t, F.lit(_WHOLE)), trimmed.try_cast("long"))
    d = F.when(F.regexp_like(t, F.lit(_REAL)), trimmed.try_cast("double"))
    number = _either(i.isNotNull(), i, d).col
    return Value(F.coalesce(number, mixed(v)), "mixed")


def _as_text(v: Value) -> Value:
    if v.kind in ("int", "real"):
        return Value(text(v), "text", literal=None if v.literal is None else str(v.literal) if v.kind == "int" else real_text(v.literal))
    if v.kind == "mixed":
        return Value(F.when(_field(v, "cls") == NUMBER, mixed(Value(text(v), "text"))).otherwise(v.col), "mixed")
    return v


def _alike(a: Value, b: Value) -> tuple[Value, Value]:
    """Both sides after the affinity rules."""
    if a.affinity in _NUMERIC or b.affinity in _NUMERIC:
        # stored numbers are numbers already: only a side without numeric affinity is read
        return (a if a.affinity in _NUMERIC else _as_numeric(a)), (b if b.affinity in _NUMERIC else _as_numeric(b))
    if a.affinity == "text" and b.affinity is None:
        return a, _as_text(b)
    if b.affinity == "text" and a.affinity is None:
        return _as_text(a), b
    return a, b


_OPS = {
    "=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y,
    "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
}


@bound
def compare(op: str, a: Value, b: Value) -> Value:
    """= != < <= > >=, NULL if a side is NULL; IS, ISNOT, which never are."""
    a, b = _alike(a, b)
    if op in ("IS", "ISNOT"):
        if a.kind == "null" or b.kind == "null":
            other = b if a.kind == "null" else a
            same = F.lit(True) if other.kind == "null" else other.col.isNull()
        elif _CLASS.get(a.kind) == _CLASS.get(b.kind) is not None:
            same = a.col.eqNullSafe(b.col)
        else:
            same = mixed(a).eqNullSafe(mixed(b))
        return condition(same if op == "IS" else ~same)
    if a.kind == "null" or b.kind == "null":
        return condition(F.lit(None).cast("boolean"))
    if "other" in (a.kind, b.kind):
        raise DialectError("this column's type takes no part in comparisons")
    ca, cb = _CLASS.get(a.kind), _CLASS.get(b.kind)
    if ca is not None and ca == cb:
        return condition(_OPS[op](a.col, b.col))
    if ca is not None and cb is not None:  # decided by class; NULL where either is
        found = {"=": False, "!=": True, "<": ca < cb, "<=": ca < cb, ">": ca > cb, ">=": ca > cb}[op]
        return condition(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(found)))
    x, y = mixed(a), mixed(b)
    return condition(F.when(x.isNotNull() & y.isNotNull(), _compare_mixed(op, x, y)))


def _compare_mixed(op: str, x: Column, y: Column) -> Column:
    # fields that the class leaves empty sort equal; a REAL and an INTEGER of one value are equal
    order = lambda m: F.struct(m.getField("cls"), m.getField("num"), m.getField("t"), m.getField("b"))
    near = {"=": x.getField("i").eqNullSafe(y.getField("i")) | x.getField("i").isNull() | y.getField("i").isNull()}
    same = order(x).eqNullSafe(order(y)) & near["="]
    both = x.getField("i").isNotNull() & y.getField("i").isNotNull()
    less = F.when(both, x.getField("i") < y.getField("i")).otherwise(order(x) < order(y))
    return {"=": same, "!=": ~same, "<": less & ~same, "<=": less | same, ">": ~less & ~same, ">=": ~less | same}[op]


def member(v: Value, items: list[Value], negated: bool) -> Value:
    """IN: the left side's affinity alone counts."""
    if not items:
        found = F.lit(False)
    else:
        sides = [_alike(v, replace(x, affinity=None)) for x in items]
        plain = all(_CLASS.get(a.kind) == _CLASS.get(b.kind) is not None and a.col is v.col for a, b in sides)
        if plain and all(b.literal is not None for _, b in sides):
            found = v.col.isin(*[b.literal for _, b in sides])
        else:
            tests = [compare("=", v, replace(x, affinity=None)).test for x in items]
            found = tests[0]
            for t in tests[1:]:
                found = found | t
    return condition(~found if negated else found)


@bound
def class_name(v: Value) -> Column:
    """typeof()"""
    names = {"int": "integer", "real": "real", "text": "text", "blob": "blob"}
    if v.kind == "null":
        return F.lit("null")
    if v.kind == "mixed":
        cls = _field(v, "cls")
        name = F.when(cls == NUMBER, F.when(_field(v, "i").isNotNull(), "integer").otherwise("real")).when(cls == TEXT, "text").otherwise("blob")
        return F.when(v.col.isNull(), F.lit("null")).otherwise(name)
    if v.kind not in names:
        raise DialectError("this column's type has no class")
    return F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(names[v.kind]))


@bound
def sort_column(v: Value) -> Column:
    if v.kind == "mixed":
        return F.when(v.col.isNotNull(), F.struct(_field(v, "cls"), _field(v, "num"), F.coalesce(_field(v, "i"), _field(v, "num").try_cast("long"), F.lit(0).cast("long")), _field(v, "t"), _field(v, "b")))
    return v.col


def unify(values: list[Value]) -> list[Value]:
    """Several results of one expression, made one class."""
    kinds = {v.kind for v in values} - {"null"}
    if not kinds:
        return values
    if len(kinds) == 1:
        kind = kinds.pop()
        spark = {"int": "long", "real": "double", "text": "string", "blob": "binary"}.get(kind)
        return [Value(v.col.cast(spark) if spark else mixed(v), kind) for v in values]
    return [Value(mixed(v), "mixed") for v in values]


@bound
def cast(v: Value, declared: str) -> Value:
    kind = affinity_of(declared)
    if v.kind == "null":
        return replace(v, affinity=kind)
    if kind == "text":
        return Value(text(v), "text", "text")
    if kind == "blob":
        return Value(text(v).cast("binary") if v.kind != "blob" else v.col, "blob", "blob")
    whole, i, d = _numbers(v)
    if kind == "integer":
        inside = F.when(d >= _I64, F.lit((1 << 63) - 1)).when(d <= -_I64, F.lit(-(1 << 63))).otherwise(F.coalesce(i, d.try_cast("long")))
        return Value(i if whole is True else inside, "int", "integer")
    if kind == "real":
        return Value(d, "real", "real")
    return replace(_either(whole, i, d), affinity="numeric")
