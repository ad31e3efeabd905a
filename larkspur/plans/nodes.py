"""The statement tree."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: int | float | str | bytes | None


@dataclass(frozen=True)
class Name:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str  # + - ~ NOT
    operand: Node


@dataclass(frozen=True)
class Binary:
    op: str  # = != < <= > >= IS ISNOT + - * / % || & | << >> AND OR LIKE GLOB
    left: Node
    right: Node


@dataclass(frozen=True)
class IsNull:
    operand: Node
    negated: bool = False


@dataclass(frozen=True)
class InList:
    operand: Node
    items: tuple[Node, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between:
    operand: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Node, ...]
    distinct: bool = False
    where: Node | None = None  # FILTER


@dataclass(frozen=True)
class Case:
    base: Node | None
    whens: tuple[tuple[Node, Node], ...]
    other: Node | None


@dataclass(frozen=True)
class Cast:
    operand: Node
    type: str


@dataclass(frozen=True)
class Frame:
    unit: str  # ROWS RANGE GROUPS
    low: float | None  # offsets from the current row; None is unbounded
    high: float | None


@dataclass(frozen=True)
class Windowed:
    call: Call
    partition: tuple[Node, ...]
    order: tuple[Key, ...]
    frame: Frame | None = None
    named: str | None = None  # a window of the WINDOW clause that this one extends


@dataclass(frozen=True)
class InQuery:
    operand: Node
    query: Select
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    query: Select


@dataclass(frozen=True)
class Scalar:
    """A subquery as a value: the first column of its first row, NULL without rows."""

    query: Select


@dataclass(frozen=True)
class Row:
    """(a, b): only compared, which the parser writes out."""

    items: tuple[Node, ...]


@dataclass(frozen=True)
class Collate:
    operand: Node
    name: str


Node = Literal | Name | Star | Unary | Binary | IsNull | InList | Between | Call | Case | Cast | Windowed | InQuery | Exists | Scalar | Collate | Row


@dataclass(frozen=True)
class Item:
    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class Key:
    expr: Node
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Source:
    table: str | Select
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str  # inner left right full cross
    source: Source
    on: Node | None = None
    using: tuple[str, ...] = ()
    natural: bool = False


@dataclass(frozen=True)
class Core:
    items: tuple[Item, ...]
    source: Source | None  # None: one row without columns
    joins: tuple[Join, ...] = ()
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None
    distinct: bool = False
    values: tuple[tuple[Node, ...], ...] = ()  # VALUES


@dataclass(frozen=True)
class Select:
    cores: tuple[Core, ...]
    operators: tuple[str, ...] = ()  # between the cores: UNION, UNION ALL, EXCEPT, INTERSECT
    order: tuple[Key, ...] = ()
    limit: int | None = None
    offset: int = 0
    explain: bool = field(default=False)
    ctes: tuple[tuple[str, tuple[str, ...], Select], ...] = ()  # name, column names, statement


def title(node: Node) -> str:
    """Column title of an expression without an alias: no spaces, no parentheses around terms."""
    match node:
        case Literal(value):
            return "NULL" if value is None else value.hex() if isinstance(value, bytes) else str(value)
        case Name(name):
            return name
        case Star():
            return "*"
        case Unary(op, operand):
            return f"{op} {title(operand)}" if op.isalpha() else op + title(operand)
        case Binary(op, left, right):
            shown = {"ISNOT": "IS NOT"}.get(op, op)
            return f"{title(left)} {shown} {title(right)}" if op.isalpha() else f"{title(left)}{op}{title(right)}"
        case IsNull(operand, negated):
            return f"{title(operand)} IS {'NOT ' * negated}NULL"
        case InList(operand, items, negated):
            return f"{title(operand)} {'NOT ' * negated}IN ({','.join(map(title, items))})"
        case Between(operand, low, high, negated):
            return f"{title(operand)} {'NOT ' * negated}BETWEEN {title(low)} AND {title(high)}"
        case Call(name, args, distinct, _):
            return f"{name}({'DISTINCT ' * distinct}{','.join(map(title, args))})"
        case Cast(operand, kind):
            return f"CAST({title(operand)} AS {kind})"
        case Case():
            return "CASE"
        case Windowed(call):
            return f"{title(call)} OVER"
        case InQuery(operand, _, negated):
            return f"{title(operand)} {'NOT ' * negated}IN (SELECT)"
        case Exists():
            return "EXISTS"
        case Scalar():
            return "(SELECT)"
        case Row(items):
            return f"({','.join(map(title, items))})"
        case Collate(operand, name):
            return f"{title(operand)} COLLATE {name}"
    raise TypeError(node)
