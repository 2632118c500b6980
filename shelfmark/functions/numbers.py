"""Bits, pairs and shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two longs."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def long_of_hex(column: Column | str) -> Column:
    """The signed long whose bits 16 hex digits spell."""
    return F.conv(column, 16, -10).cast("long")


def hex_of_long(column: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def aspect_delta(width_a: Column, height_a: Column, width_b: Column, height_b: Column) -> Column:
    """Relative difference of two width-to-height ratios."""
    a, b = width_a / height_a, width_b / height_b
    return F.abs(a - b) / F.greatest(a, b)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def one_hot(column: Column | str, values: tuple[str, ...], prefix: str) -> list[Column]:
    """A byte column prefix_value for each value; all zero for null."""
    c = F.col(column) if isinstance(column, str) else column
    return [F.coalesce((c == v).cast("byte"), F.lit(0).cast("byte")).alias(f"{prefix}_{v}") for v in values]


def tri_state(column: Column | str) -> Column:
    """1, 0 or, for null, -1 as a byte."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("byte"), F.lit(-1).cast("byte"))


def truncated(text: Column | str, most: int = 80) -> Column:
    """At most `most` characters, the last three as dots where cut."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def mapped(column: Column | str, values: dict) -> Column:
    """A total lookup: a value without an entry raises when run."""
    c = F.col(column) if isinstance(column, str) else column
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    got = table[c]
    return F.when(got.isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(c.cast("string"), F.lit("null"))))).otherwise(got)
