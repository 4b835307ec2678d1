"""Columns over 16-bit words of a token stream. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format: header words of included lines; low bytes of the word families; type suffixes by high byte.
INCLUDED_HEADERS = (2, 3, 52, 53)
ACCESS = {11: "LOAD", 12: "STORE", 13: "DECL", 14: "ARRAY", 15: "ARRSET", 16: "ARRDECL"}
SUFFIX = {0: "", 4: "%", 8: "&", 12: "!", 16: "#", 20: "$"}
SUFFIX_LATER = {0: "", 4: "%", 8: "&", 12: "!", 16: "#", 20: "@", 24: "$"}
CONVERT = {1: "CINT", 2: "CLNG", 3: "CSNG", 4: "CDBL"}
OPEN_ACCESS = {1: "READ", 2: "WRITE", 3: "READ WRITE"}
OPEN_LOCKS = {16: "LOCK READ WRITE", 32: "LOCK WRITE", 48: "LOCK READ", 64: "SHARED"}
DEFTYPES = {1: "DEFINT", 2: "DEFLNG", 3: "DEFSNG", 4: "DEFDBL", 5: "DEFSTR"}
def _pick(key: Column, values: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in reversed(values.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def low_byte(word: Column) -> Column:
    return word.bitwiseAND(F.lit(255))


def high_byte(word: Column) -> Column:
    return F.shiftright(word, 8)


def is_line_header(word: Column) -> Column:
    """Only the escape and label bits may be set below the indent, or it is an included line's header."""
    return word.isin(*INCLUDED_HEADERS) | (word.bitwiseAND(F.lit(1018)) == 0)


def indent(word: Column) -> Column:
    return F.shiftright(word, 10)


def escaped_indent(word: Column) -> Column:
    """An escape word is a header again, or the plain number of blanks."""
    return F.when(word.bitwiseAND(F.lit(1023)) == 0, F.shiftright(word, 10)).otherwise(word)


def immediate_value(word: Column) -> Column:
    high = high_byte(word)
    return F.when((low_byte(word) == 100) & (high % 4 == 1), F.shiftright(high - 1, 2))


def constant_op(word: Column) -> Column:
    high = high_byte(word)
    return F.when((low_byte(word) == 101) & (high % 4 == 1), "PUSH_INT").when(immediate_value(word).isNotNull(), F.concat(F.lit("PUSH_"), immediate_value(word).cast("string")))


def convert_op(word: Column) -> Column:
    high = high_byte(word)
    return F.when((low_byte(word) == 8) & (high % 4 == 1), _pick(F.shiftright(high - 1, 2), CONVERT))


def variable_op(word: Column, suffixes: dict = SUFFIX) -> Column:
    return F.concat(_pick(low_byte(word), ACCESS), _pick(high_byte(word), suffixes))


def family_mnemonic(word: Column, suffixes: dict = SUFFIX) -> Column:
    """Mnemonic of words that a rule makes: variable access, constants, conversions."""
    return F.coalesce(variable_op(word, suffixes), constant_op(word), convert_op(word))


def family_operands(word: Column) -> Column:
    """Kinds of the operands of those words."""
    kinds = lambda *k: F.array(*map(F.lit, k)) if k else F.array().cast("array<string>")
    indexed = low_byte(word).isin(*(k for k, v in ACCESS.items() if v.startswith("ARR")))
    by_family = F.when(variable_op(word).isNotNull() & indexed, kinds("u16", "ref")).when(variable_op(word).isNotNull(), kinds("ref")).when(constant_op(word) == "PUSH_INT", kinds("u16"))
    return by_family.when(family_mnemonic(word).isNotNull(), kinds())


def immediate_opcode(value: Column) -> Column:
    """The word that carries a small constant; none beyond 10."""
    return F.when(value.between(0, 10), F.shiftleft(value * 4 + 1, 8).bitwiseOR(F.lit(100)))


def variable_opcode(access: Column, suffix: Column) -> Column:
    low = _pick(access, {v: k for k, v in ACCESS.items()})
    return F.shiftleft(_pick(suffix, {v: k for k, v in SUFFIX.items()}), 8).bitwiseOR(low)


def open_clauses(word: Column) -> Column:
    """Access and lock clauses of an OPEN."""
    high = high_byte(word)
    part = lambda key, values: F.coalesce(F.concat(F.lit(" "), _pick(key, values)), F.lit(""))
    access = _pick(high.bitwiseAND(F.lit(3)), OPEN_ACCESS)
    return F.concat(F.coalesce(F.concat(F.lit(" ACCESS "), access), F.lit("")), part(high.bitwiseAND(F.lit(112)), OPEN_LOCKS))


def signature_bits(kind: Column) -> dict[str, Column]:
    return {
        "is_function": F.shiftright(kind, 8).bitwiseAND(F.lit(3)) == 2,
        "cdecl": kind.bitwiseAND(F.lit(32768)) != 0,
        "alias_len": F.shiftright(kind, 10).bitwiseAND(F.lit(31)),
        "return_suffix": F.when(kind.bitwiseAND(F.lit(128)) != 0, _pick(kind.bitwiseAND(F.lit(127)), {1: "%", 2: "&", 3: "!", 4: "#", 5: "$"}, "")).otherwise(""),
    }


def param_bits(mode: Column) -> dict[str, Column]:
    names = {"has_suffix": 512, "is_array": 1024, "by_segment": 2048, "by_value": 4096, "has_as": 8192}
    return {k: mode.bitwiseAND(F.lit(v)) != 0 for k, v in names.items()}


def label_bucket(number: Column) -> Column:
    """Chain of a numeric label."""
    return 32 + F.shiftright(number.bitwiseXOR(F.shiftright(number, 8)), 1).bitwiseAND(F.lit(7))
