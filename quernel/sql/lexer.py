"""Tokens of the SQL surface."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import ParseError


class Token(NamedTuple):
    kind: str  # word, quoted, string, number, symbol, json, end
    text: str
    at: int


_SPACE = re.compile(r"(?:\s+|--[^\n]*)*")
_NUMBER = re.compile(r"\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?")
_WORD = re.compile(r"[^\W\d]\w*")
_SYMBOLS = ("@@", ">=", "<=", "<>", "!=", "(", ")", ",", ".", ";", "=", "<", ">", "*", "[", "]", "-", "+")


def _string(sql: str, at: int) -> tuple[str, int]:
    """A quoted string from its opening mark; a backslash or a doubled mark escapes the mark."""
    mark, out, i = sql[at], [], at + 1
    while i < len(sql):
        c = sql[i]
        if c == "\\" and i + 1 < len(sql) and sql[i + 1] == mark:
            out.append(mark)
            i += 2
        elif c == mark:
            if sql[i + 1 : i + 2] != mark:
                return "".join(out), i + 1
            out.append(mark)
            i += 2
        else:
            out.append(c)
            i += 1
    raise ParseError(f"unterminated string at {at}")


def _object(sql: str, at: int) -> int:
    """Where a bare JSON object ends."""
    depth, i, in_string = 0, at, False
    while i < len(sql):
        c = sql[i]
        if in_string:
            i += c == "\\"
            in_string = c != '"' or sql[i - 1] == "\\"
        elif c == '"':
            in_string = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    raise ParseError(f"unterminated object at {at}")


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while True:
        at = _SPACE.match(sql, at).end()
        if at >= len(sql):
            return [*out, Token("end", "", at)]
        c = sql[at]
        if c in "'\"":
            text, end = _string(sql, at)
            out.append(Token("string", text, at))
        elif c == "`":
            end = sql.find("`", at + 1) + 1
            if not end:
                raise ParseError(f"unterminated name at {at}")
            out.append(Token("quoted", sql[at + 1 : end - 1], at))
        elif c == "{":
            end = _object(sql, at)
            out.append(Token("json", sql[at:end], at))
        elif m := _NUMBER.match(sql, at):
            end = m.end()
            out.append(Token("number", m[0], at))
        elif m := _WORD.match(sql, at):
            end = m.end()
            out.append(Token("word", m[0], at))
        else:
            symbol = next((s for s in _SYMBOLS if sql.startswith(s, at)), None)
            if symbol is None:
                raise ParseError(f"unexpected {c!r} at {at}")
            end = at + len(symbol)
            out.append(Token("symbol", symbol, at))
        at = end
