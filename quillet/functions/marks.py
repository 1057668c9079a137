"""Printed marks: an eight-bit code for numbers to 15 that mends one error, as Column lookups.

The code's tables are made from its rule in Python and enter a plan as one constant array each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Places of the data bits, the mask on a field's number, and the sheets' own id.
DATA_BITS = (3, 5, 6, 7)
NUMBER_MASK = 0b0000_0110
PROJECT_ID = ord("P")


def encoded(number: int) -> int:
    """Eight bits: data at its places, each parity place even over the places it is part of, and even in all."""
    places = {p for k, p in enumerate(DATA_BITS) if number >> k & 1}
    places |= {c for c in (1, 2, 4) if sum(1 for p in places & set(DATA_BITS) if p & c) % 2}
    return sum(1 << p for p in places) | len(places) % 2


def decoded(byte: int) -> int | None:
    """The number of the one codeword within one bit; None where there is none."""
    near = [n for n in range(16) if (encoded(n) ^ byte).bit_count() <= 1]
    return near[0] if near else None


ENCODED = [encoded(n) for n in range(16)]
DECODED = [decoded(b) for b in range(256)]
REVERSED = [int(f"{b:08b}"[::-1], 2) for b in range(256)]


def _lookup(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("int") for v in values]), index.cast("int") + 1)


def encode(number: Column) -> Column:
    return _lookup(ENCODED, number)


def decode(byte: Column) -> Column:
    return _lookup(DECODED, byte)


def reversed_bits(byte: Column) -> Column:
    return _lookup(REVERSED, byte)


def field(value: Column, own: int = PROJECT_ID) -> Column:
    """struct(kind, number) of sixteen printed marks: foreign, damaged, or a number under the own id."""
    ident = reversed_bits(value.bitwiseAND(F.lit(0xFF)))
    number = decode(reversed_bits(F.shiftright(value, 8).bitwiseAND(F.lit(0xFF))).bitwiseXOR(F.lit(NUMBER_MASK)))
    kind = F.when(F.bit_count(ident.bitwiseXOR(F.lit(own))) > 1, "foreign").when(number.isNull(), "damaged").otherwise("number")
    return F.struct(kind.alias("kind"), F.when(kind == "number", number).alias("number"))
