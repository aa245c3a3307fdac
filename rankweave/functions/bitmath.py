"""Bit arithmetic as Column expressions. Values are non-negative BIGINTs; words are 64-bit patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ilog2(x: Column) -> Column:
    """Floor of log2, for x > 0."""
    return (F.length(F.bin(x)) - 1).cast("long")


def bit_floor(x: Column) -> Column:
    """The largest power of two that is not above x; 0 for 0."""
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), ilog2(x).cast("int")))


def one_mask(n: Column) -> Column:
    """n low bits set, n from 0 to 63."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n.cast("int")))


def trailing_zeros(x: Column) -> Column:
    """Zero bits below the lowest set bit; 64 for 0."""
    return F.bit_count(x.bitwiseAND(-x) - 1).cast("long")


def popcount(x: Column) -> Column:
    return F.bit_count(x).cast("long")


def reverse_low_bits(x: Column, n: int) -> Column:
    """The low n bits of x in reverse order, n from 1 to 63: neighbours of 1, 2, 4, ... bits change places."""
    right = lambda c, k: F.call_function("shiftrightunsigned", c, F.lit(k))
    x = x.cast("long")
    for k, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = right(x, k).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), k))
    return right(x, 64 - n)


def gamma_bits(x: Column) -> Column:
    """Bits of the Elias gamma code of x > 0."""
    return 2 * ilog2(x) + 1


def select_in_word(word: Column, k: Column) -> Column:
    """Position of the k-th (0-based) set bit of a 64-bit word, null if it has fewer."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(word, i) == 1)
    return F.get(places, k.cast("int")).cast("long")


def num_levels(max_symbol: int) -> int:
    return max(1, int(max_symbol).bit_length())
