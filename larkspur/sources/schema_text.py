"""Column definitions and indexes from the text of CREATE statements."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.values import affinity_of
from ..plans.parser import Token, tokenize

_CONSTRAINT = {"PRIMARY", "NOT", "NULL", "UNIQUE", "CHECK", "DEFAULT", "COLLATE", "REFERENCES", "GENERATED", "AS", "CONSTRAINT"}
_TABLE_CONSTRAINT = {"PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT"}


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    declared: str
    affinity: str
    is_rowid: bool = False


@dataclass(frozen=True)
class IndexInfo:
    name: str
    table: str
    columns: tuple[tuple[str, bool], ...]  # name, descending
    unique: bool


def _unquoted(t: Token) -> str:
    if t.kind in ("quoted", "text"):
        q = t.text[0]
        return t.text[1:-1] if q == "[" else t.text[1:-1].replace(q * 2, q)
    return t.text


def _parts(sql: str) -> tuple[list[Token], list[list[Token]], list[Token]]:
    """Tokens before the first parenthesis, the comma-separated parts inside it, tokens after it."""
    head, parts, part, depth, rest = [], [], [], 0, []
    closed = False
    for t in tokenize(sql)[:-1]:
        if closed:
            rest.append(t)
        elif depth == 0 and t.text == "(":
            depth = 1
        elif depth == 0:
            head.append(t)
        elif depth == 1 and t.text == ",":
            parts.append(part)
            part = []
        elif depth == 1 and t.text == ")":
            parts.append(part)
            closed = True
        else:
            depth += {"(": 1, ")": -1}.get(t.text, 0)
            part.append(t)
    return head, [p for p in parts if p], rest


def has_rowid(sql: str) -> bool:
    return all(t.text.upper() != "WITHOUT" for t in _parts(sql)[2])


def columns_of(sql: str) -> list[ColumnInfo]:
    """The columns of a CREATE TABLE statement; the INTEGER PRIMARY KEY is marked."""
    parts = _parts(sql)[1]
    out: list[ColumnInfo] = []
    key: str | None = None
    for part in parts:
        if part[0].kind == "word" and part[0].text.upper() in _TABLE_CONSTRAINT and out:
            words = [t.text.upper() for t in part]
            if "PRIMARY" in words and words.count(",") == 0:
                inside = [t for t in part[words.index("PRIMARY") + 2 :] if t.text not in "()" and t.text.upper() not in ("ASC", "DESC")]
                key = _unquoted(inside[0]).lower() if inside else None
            continue
        declared, i = [], 1
        depth = 0
        while i < len(part) and (depth or part[i].text.upper() not in _CONSTRAINT or part[i].kind in ("quoted", "text")):
            depth += {"(": 1, ")": -1}.get(part[i].text, 0)
            declared.append(_unquoted(part[i]))
            i += 1
        kind = " ".join(declared).replace(" ( ", "(").replace(" , ", ",").replace(" )", ")")
        words = [t.text.upper() for t in part[i:]]
        primary = any(a == "PRIMARY" and b == "KEY" for a, b in zip(words, words[1:], strict=False)) and "DESC" not in words
        out.append(ColumnInfo(_unquoted(part[0]), kind, affinity_of(kind), primary and kind.upper() == "INTEGER"))
    return [c if not (key == c.name.lower() and c.declared.upper() == "INTEGER") else ColumnInfo(c.name, c.declared, c.affinity, True) for c in out]


def index_of(sql: str) -> IndexInfo:
    head, parts, _ = _parts(sql)
    words = [t.text.upper() for t in head]
    on = words.index("ON")
    columns = tuple((_unquoted(p[0]), any(t.text.upper() == "DESC" for t in p[1:])) for p in parts)
    return IndexInfo(_unquoted(head[on - 1]), _unquoted(head[on + 1]), columns, "UNIQUE" in words)
