"""Floating-point numbers older than IEEE: exponent byte last, biased by 129, the sign where the leading 1 would be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

# The largest magnitudes.
SINGLE_MAX, DOUBLE_MAX = 1.7014117331926443e38, 1.7014118346046923e38


def decode(data: Column, bits: int) -> Column:
    """bits: 24 or 56. Null for another length."""
    size, top = (bits + 8) // 8, 1 << bits - 1

    def value(digits: Column) -> Column:  # the exponent's byte first
        exponent = F.conv(F.substring(digits, 1, 2), 16, 10).cast("int")
        return bind(F.conv(F.substring(digits, 3, 2 * size - 2), 16, 10).cast("bigint"), lambda body: F.when(exponent == 0, 0.0).otherwise(signed(body) * F.pow(F.lit(2.0), exponent - 129 - bits + 1)))

    def signed(body: Column) -> Column:
        mantissa = body.bitwiseAND(F.lit(top - 1)).bitwiseOR(F.lit(top)).cast("double")
        return F.when(body.bitwiseAND(F.lit(top)) != 0, -mantissa).otherwise(mantissa)

    flipped = lambda h: F.array_join(F.reverse(F.regexp_extract_all(h, F.lit(".."), 0)), "")
    return bind(F.hex(data), lambda h: F.when(F.length(h) == 2 * size, bind(flipped(h), value)))


def encode_hex(value: Column, bits: int) -> Column:
    """Hex digits of the bytes; null for what has none (see error). Singles are narrowed first."""
    size, digits, top = (bits + 8) // 8, min(bits, 53), 1 << bits - 1
    two = lambda e: F.pow(F.lit(2.0), e)

    def exponent(x: Column) -> Column:
        return bind(F.floor(F.log2(x)), lambda g: F.when(x < two(g), g - 1).when(x >= two(g + 1), g + 1).otherwise(g))

    def written(x: Column, e: Column, negative: Column) -> Column:
        mantissa = F.shiftleft((x / two(e - (digits - 1))).cast("bigint"), bits - digits)
        body = mantissa.bitwiseAND(F.lit(top - 1)).bitwiseOR(F.when(negative, F.lit(top)).otherwise(F.lit(0)))
        # the exponent's byte first, then all turned round
        whole = F.concat(F.lpad(F.hex(e + 129), 2, "0"), F.lpad(F.hex(body), 2 * size - 2, "0"))
        text = F.lower(F.array_join(F.reverse(F.regexp_extract_all(whole, F.lit(".."), 0)), ""))
        return F.when((x == 0) | (e + 129 <= 0), "00" * size).otherwise(text)

    narrowed = value.cast("float").cast("double") if bits == 24 else value
    made = bind(narrowed, lambda x: bind(F.abs(x), lambda a: bind(exponent(a), lambda e: F.when(a == 0, "00" * size).otherwise(written(a, e, x < 0)))))
    return F.when(error(value, bits).isNull(), made)


def error(value: Column, bits: int) -> Column:
    limit = SINGLE_MAX if bits == 24 else DOUBLE_MAX
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), "not finite").when(F.abs(value) > limit, "too large")
