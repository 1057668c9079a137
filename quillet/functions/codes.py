"""Arithmetic over the integers modulo 29 and small printed codes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The symbol alphabet, the two rows of parity weights, and the marks' own code.
MODULUS = 29
ALPHABET = "=#ABCDEFGHIJKLMNOPQRSTUVWXYZ-"
CHECKSUM_WEIGHTS = ((14, 2, 11, 15), (6, 20, 12, 22))


def add(a: Column, b: Column) -> Column:
    return F.pmod(a + b, F.lit(MODULUS))


def sub(a: Column, b: Column) -> Column:
    return F.pmod(a - b, F.lit(MODULUS))


def mul(a: Column, b: Column) -> Column:
    return F.pmod(a * b, F.lit(MODULUS))


def inv(a: Column) -> Column:
    """The inverse; null for zero. A lookup of 28 values made from the rule a ** 27."""
    table = F.array(*[F.lit(pow(k, MODULUS - 2, MODULUS)) for k in range(1, MODULUS)])
    r = F.pmod(a, F.lit(MODULUS)).cast("int")
    return F.when(r != 0, F.element_at(table, F.greatest(r, F.lit(1))))


def symbols(text: Column) -> Column:
    """Residues of a text's characters, in either case; null where one is no symbol."""
    found = F.transform(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.when(F.forall(found, lambda s: s >= 0), found)


def text_of(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda s: F.substring(F.lit(ALPHABET), s + 1, F.lit(1))), "")


def checksum(letters: Column) -> Column:
    """The two parity symbols of four letters."""
    return F.array(*[F.pmod(sum((F.element_at(letters, k + 1) * w for k, w in enumerate(row)), F.lit(0)), F.lit(MODULUS)) for row in CHECKSUM_WEIGHTS])


def codeword(letters: Column) -> Column:
    return F.concat(checksum(letters), letters)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, d: n + d)


def wheel(pointer: Column, window: Column) -> Column:
    """What a window of the wheel shows when the pointer is on a symbol."""
    return F.when(pointer == 0, F.pmod(window, F.lit(MODULUS))).otherwise(mul(pointer, window + 15))


def on_line(intercept: Column, slope: Column, index: Column) -> Column:
    return F.pmod(intercept + slope * index, F.lit(MODULUS))


def slope(a: Column, b: Column, index_a: Column, index_b: Column) -> Column:
    """The slope of the line through two points; null where the indices are the same."""
    return mul(sub(b, a), inv(index_b - index_a))
