"""Elias gamma codes as bit strings, common prefixes, front coding in blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM_BLOCK, PRODUCT_BLOCK = 24, 6


def gamma_encode(n: Column) -> Column:
    """floor(log2 n) ones, a zero, and n's binary digits but the first; null below 1."""
    digits = F.bin(n)
    return F.when(n >= 1, F.concat(F.repeat(F.lit("1"), F.length(digits) - 1), F.lit("0"), F.substring(digits, 2, 64)))


def gamma_decode(code: Column) -> Column:
    ones = F.length(code) - F.length(F.ltrim(code, F.lit("1")))
    ones = F.least(ones, F.floor((F.length(code) - 1) / 2).cast("int"))
    return F.conv(F.concat(F.lit("1"), F.substring(code, ones + 2, F.length(code))), 2, 10).cast("long")


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that a and b begin with alike; 0 with a null."""
    most = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), most), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.when(a.isNull() | b.isNull() | (most < 1), F.lit(0)).otherwise(same)


def front_encode(ordinal: Column, term: Column, previous: Column, block: int) -> tuple[Column, Column]:
    """(prefix taken from the term before, rest); heads of blocks are whole, with prefix 0."""
    head = ordinal % block == 0
    shared = F.when(head, F.lit(0)).otherwise(common_prefix(previous, term))
    return shared, F.when(head, term).otherwise(F.substring(term, shared + 1, F.length(term)))


def front_decode(coded: Column) -> Column:
    """The terms of one block from its array of (prefix, rest), in order."""
    empty = F.array().cast("array<string>")
    return F.aggregate(coded, empty, lambda done, x: F.concat(done, F.array(F.concat(F.substring(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), F.lit(1), x["prefix"]), x["rest"]))))
