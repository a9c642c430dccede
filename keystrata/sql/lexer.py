"""Tokens of the strict dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from keystrata.errors import SqlError
from keystrata.types import INT64_MAX, INT64_MIN

_TOKEN = re.compile(r"(?P<space>\s+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<int>-?[0-9]+)|(?P<text>'[^']*')|(?P<symbol><=|>=|[(),;*=<>])")


@dataclass(frozen=True)
class Token:
    kind: str  # name, int, text, symbol or end
    text: str
    value: int | str | None = None

    def is_word(self, word: str) -> bool:
        """Keywords are names, in any case; they aren't reserved."""
        return self.kind == "name" and self.text.upper() == word


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError("string isn't closed" if sql[at] == "'" else f"unexpected character {sql[at]!r}")
        at = m.end()
        if m.lastgroup == "space":
            continue
        value: int | str | None = None
        if m.lastgroup == "int":
            value = int(m[0])
            if not INT64_MIN <= value <= INT64_MAX:
                raise SqlError(f"integer out of range: {m[0]}")
        elif m.lastgroup == "text":
            value = m[0][1:-1]
        out.append(Token(m.lastgroup or "", m[0], value))
    out.append(Token("end", ""))
    return out
