"""Result rows as text, one line a row."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from .functions.values import real_text


def value_text(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return real_text(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "replace")
    if hasattr(v, "cls") and hasattr(v, "asDict"):  # a value whose class varies by row
        return value_text(next((x for x in (v.t, None if v.b is None else bytes(v.b), v.i, v.num) if x is not None), None))
    return str(v)


@dataclass
class ListFormatter:
    headers: bool = False
    separator: str = "|"
    mode: str = "list"

    def rows(self, names: list[str], rows: Iterable[tuple]) -> str:
        lines = [self.separator.join(names)] if self.headers else []
        lines += [self.separator.join(map(value_text, r)) for r in rows]
        return "\n".join(lines)
