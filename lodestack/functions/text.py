"""Columns over source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value of the language: names, with the suffix of their type.
NAME = r"[A-Za-z][A-Za-z0-9_.]*[%&!#$]?"
#: Where lines end in text that was read as Latin-1.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85]"


def bind(value: Column, use) -> Column:
    """use(value), with value computed once: what a lambda binds isn't written out again at each place."""
    return F.get(F.transform(F.array(value), use), 0)


def names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NAME), 0)


def numtype(literal: Column) -> Column:
    """Type that a numeric literal spells: by suffix, by form, by size."""
    low = F.lower(literal)
    digits = F.regexp_replace(F.regexp_replace(low, "^[&ho]+", ""), "&+$", "")
    based = F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10).cast("bigint")
    octal = F.conv(F.when(digits == "", "0").otherwise(digits), 8, 10).cast("bigint")
    based = F.when(low.startswith("&h"), based).otherwise(octal)
    decimal = literal.try_cast("bigint")
    return (
        F.when(low.endswith("#"), "double").when(low.endswith("!"), "single").when(low.endswith("&"), "long").when(low.endswith("%"), "integer")
        .when(low.startswith("&"), F.when(based <= 65535, "integer").otherwise("long"))
        .when(low.contains("d"), "double").when(low.contains(".") | low.contains("e"), "single")
        .when(decimal.between(-32768, 32767), "integer").otherwise("long")
    )


def source_indent(line: Column) -> Column:
    """Column of the first character that is no blank, tabs to the next eighth."""
    lead = F.regexp_extract(line, "^[ \t]*", 0)
    # blanks before a tab count only in whole eighths
    cut = F.split(lead, "\t")
    before = F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0)))
    return F.aggregate(before, F.lit(0), lambda n, s: n + (F.floor(F.length(s) / 8).cast("int") + 1) * 8) + F.length(F.element_at(cut, -1))


def indent_white(width: Column, tabs: bool) -> Column:
    if not tabs:
        return F.repeat(F.lit(" "), width)
    return F.concat(F.repeat(F.lit("\t"), F.floor(width / 8).cast("int")), F.repeat(F.lit(" "), (width % 8).cast("int")))


def long_literal(value: Column, base: int) -> Column:
    """A long constant; the suffix only where it would read as an integer."""
    text = {10: value.cast("string"), 16: F.concat(F.lit("&H"), F.hex(value)), 8: F.concat(F.lit("&O"), F.conv(value.cast("string"), 10, 8))}[base]
    fits = value.between(-32768, 32767) if base == 10 else value <= 65535
    return F.when(fits, F.concat(text, F.lit("&"))).otherwise(text)


def aligned(text: Column, column: Column, comment: Column, base: Column | int = 0, colon: Column | bool = False) -> Column:
    """text, then comment at its column, counted from base (an indent, or a label's width). Without room it follows at once; a colon keeps one blank."""
    gap = colon.cast("int") if isinstance(colon, Column) else F.lit(int(colon))
    code = F.concat(text, F.repeat(F.lit(":"), gap))
    return bind(code, lambda c: F.concat(F.rpad(c, F.greatest(column - base, F.length(c) + gap).cast("int"), " "), comment))


def looks_like_text(head: Column) -> Column:
    """head: text read as Latin-1. No NUL, and under 2 % control characters other than tab, line ends and end of file."""
    control = F.length(head) - F.length(F.regexp_replace(head, "[\x01-\x08\x0b\x0c\x0e-\x19\x1b-\x1f]", ""))
    return (F.length(head) > 0) & ~F.contains(head, F.lit("\x00")) & (control / F.length(head) < 0.02)


def hexdump(data: Column) -> Column:
    """Rows (offset, hex, printable text) of 16 bytes."""
    n = F.octet_length(data)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(16))).otherwise(F.array().cast("array<int>"))

    def row(at: Column) -> Column:
        part = F.substring(data, at + 1, F.lit(16))
        hexed = F.trim(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 "))
        shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), "[^\x20-\x7e]", ".")
        return F.struct(at.alias("off"), hexed.alias("hex"), shown.alias("shown"))

    return F.transform(starts, row)


def letter_bits(head: Column, tail: Column) -> Column:
    """The two masks of a record as 26 bits of a number, A the highest of 32: A to P from head, Q to Z from the top of tail."""
    return F.shiftleft(head.cast("bigint"), 16).bitwiseOR(tail.cast("bigint").bitwiseAND(F.lit(0xFFC0)))


def _letters(bits: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(25)), lambda i: F.call_function("shiftright", bits, 31 - i).bitwiseAND(F.lit(1)) == 1)


def mask_letters(head: Column, tail: Column) -> Column:
    """Letter numbers (A is 0) of the two masks."""
    return bind(letter_bits(head, tail), _letters)


def deftype_ranges(head: Column, tail: Column) -> Column:
    """The masks' letters as ranges, A-C, F: a letter opens one if the bit before is off, and closes it if the bit after is."""
    name = lambda x: F.char(x + 65)
    show = lambda a, b: F.when(a == b, name(a)).otherwise(F.concat(name(a), F.lit("-"), name(b)))

    def ranges(m: Column) -> Column:
        opens = m.bitwiseAND(F.bitwise_not(F.shiftright(m, 1)))
        closes = m.bitwiseAND(F.bitwise_not(F.shiftleft(m, 1)))
        return F.array_join(F.zip_with(_letters(opens), _letters(closes), show), ", ")

    return bind(letter_bits(head, tail), ranges)


def deftype_state(head: Column, tail: Column, default: int = 3) -> Column:
    """Type of each of the 26 letters by a record's masks: the one that tail ends in, or the language's own."""
    found = mask_letters(head, tail)
    return F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.when(F.array_contains(found, i), tail.bitwiseAND(F.lit(63))).otherwise(F.lit(default)))
