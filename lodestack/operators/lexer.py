"""Lines of source as tokens, by a scanner over the language's own classes of characters."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..functions.text import NAME

SUFFIXES = "%&!#$"
# Fixed values of the language: operators of two characters, the others, and the digits of each base.
PAIRS = ("<=", ">=", "<>", "><", "=<", "=>")
SINGLES = "-+*/\\^=<>(),;:#?"
DIGITS = {"H": "0123456789ABCDEF", "O": "01234567", "": "01234567"}
_NAME = re.compile(NAME)
NUMBER, WORD, STRING, OP, END = "NUMBER", "NAME", "STRING", "OP", "END"


class Token(NamedTuple):
    kind: str
    text: str
    suffix: str
    at: int

    @property
    def word(self) -> str:
        """What a name or operator says, case aside; nothing for a string or a number."""
        return (self.text + self.suffix).upper() if self.kind in (WORD, OP) else ""


def _run(line: str, at: int, allowed: str) -> int:
    while at < len(line) and line[at].upper() in allowed:
        at += 1
    return at


def number_end(line: str, at: int) -> int:
    """Where the number at a place ends; the place itself if there is none."""
    decimal = DIGITS["H"][:10]
    if line[at] == "&":
        mark = line[at + 1 : at + 2].upper()
        base = mark if mark in ("H", "O") else ""
        first = at + 1 + len(base)
        end = _run(line, first, DIGITS[base])
        return end + (line[end : end + 1] == "&") if end > first else at
    whole = _run(line, at, decimal)
    end = whole
    if line[whole : whole + 1] == ".":
        end = _run(line, whole + 1, decimal)
        if end == at + 1:
            return at
    if end == at:
        return at
    if line[end : end + 1].upper() in ("E", "D"):
        power = end + 1 + (line[end + 1 : end + 2] in ("+", "-"))
        if (last := _run(line, power, decimal)) > power:
            end = last
    return end + (line[end : end + 1] in ("!", "#", "&", "%"))


def _named(text: str, at: int) -> Token:
    body = text.rstrip(SUFFIXES)
    return Token(WORD, body, text[len(body) :], at)


def _items_end(line: str, at: int) -> int:
    """The end of DATA's items: the first colon outside quotes."""
    quoted = False
    while at < len(line) and (quoted or line[at] != ":"):
        quoted ^= line[at] == '"'
        at += 1
    return at


def lex(line: str) -> list[Token]:
    """Tokens of a line, with an END. ValueError at a character that begins none."""
    found: list[Token] = []
    at, size = 0, len(line)
    while at < size:
        c = line[at]
        if c in " \t":
            at += 1
            continue
        kind, text = found[-1][:2] if found else (None, ":")
        begins = text == ":" and kind in (OP, None)
        joins = kind == WORD or kind == OP and text == ")"
        named = _NAME.match(line, at) if c.isalpha() else None
        if named and begins and named[0].upper() in ("REM", "DATA"):
            end = len(line) if named[0].upper() == "REM" else _items_end(line, named.end())
            found += [_named(named[0].upper(), at), Token(STRING, line[named.end() : end], "", named.end())]
        elif named:
            found.append(_named(named[0], at))
            end = named.end()
        elif c == "'":
            found += [Token(OP, c, "", at), Token(STRING, line[at + 1 :], "", at + 1)]
            end = len(line)
        elif c == '"':
            close = line.find('"', at + 1)
            found.append(Token(STRING, line[at + 1 : close if close >= 0 else len(line)], "", at))
            end = close + 1 if close >= 0 else len(line)
        elif c == "." and joins and (named := _NAME.match(line, at + 1)):
            found += [Token(OP, ".", "", at), _named(named[0], at + 1)]
            end = named.end()
        elif (c in "&." or c.isdecimal() and c.isascii()) and (end := number_end(line, at)) > at:
            found.append(Token(NUMBER, line[at:end], "", at))
        elif line[at : at + 2] in PAIRS:
            found.append(Token(OP, line[at : at + 2], "", at))
            end = at + 2
        elif c in SINGLES:
            found.append(Token(OP, c, "", at))
            end = at + 1
        else:
            raise ValueError(f"unexpected character {c!r} at column {at}")
        at = end
    return [*found, Token(END, "", "", len(line))]


def number_type(text: str) -> str:
    """integer, long, single or double, as a literal's form spells."""
    low = text.lower()
    if low[0] == "&":
        return "integer" if number_value(text) <= 0xFFFF and not low.endswith("&") else "long"
    by_suffix = {"#": "double", "!": "single", "&": "long", "%": "integer"}.get(low[-1])
    if by_suffix:
        return by_suffix
    if "d" in low:
        return "double"
    if "." in low or "e" in low:
        return "single"
    return "integer" if int(low) <= 32767 else "long"


def number_value(text: str) -> float | int:
    low = text.lower()
    if low[0] == "&":
        base = 16 if low[1:2] == "h" else 8
        return int(low.lstrip("&ho").rstrip("&") or "0", base)
    low = low.rstrip("!#&%").replace("d", "e")
    return float(low) if "." in low or "e" in low else int(low)
