"""Log-linear (H2) histogram bins: linear below a cutoff, then a fixed number of bins per power of two.

Parameters a and b: values are exact to 2**a below the cutoff 2**(a+b+1) and to a relative 2**-b above.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.bitmath import ilog2


def from_mr(m: int, r: int) -> tuple[int, int]:
    """The parameters (a, b) of the classical form: 2**m is the width of the smallest bin, 2**r the cutoff."""
    if r <= m:
        raise ValueError("r must be larger than m")
    return m, r - m - 1


def cutoff(a: int, b: int) -> int:
    return 1 << (a + b + 1)


def bin_index(v: Column, a: int, b: int) -> Column:
    """The bin of a non-negative integer."""
    v = F.floor(v).cast("long")
    c, p = a + b + 1, ilog2(F.greatest(v, F.lit(1)))
    # within [2**p, 2**(p+1)): 2**b bins, the first of which has number (p - c + 2) * 2**b
    inside = F.call_function("shiftright", v - F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int")), (p - b).cast("int"))
    return F.when(v < cutoff(a, b), F.shiftright(v, a)).otherwise((p - c + 2) * (1 << b) + inside).cast("long")


def lowest(bin_: Column, a: int, b: int) -> Column:
    """The smallest value of a bin."""
    c = a + b + 1
    p = F.floor(bin_ / (1 << b)).cast("long") - 2 + c
    inside = bin_.bitwiseAND(F.lit((1 << b) - 1))
    shift = lambda x, n: F.call_function("shiftleft", x, n.cast("int"))
    above = shift(F.lit(1).cast("long"), p) + shift(inside, p - b)
    return F.when(bin_ < (cutoff(a, b) >> a), F.shiftleft(bin_, a)).otherwise(above).cast("long")


def highest(bin_: Column, a: int, b: int) -> Column:
    """The largest value of a bin."""
    return lowest(bin_ + 1, a, b) - 1


def num_bins(a: int, b: int, n: int) -> int:
    """Bins for values below 2**n."""
    c = a + b + 1
    return 1 << (n - a) if n < c else (n - c + 2) << b


def max_value(n: int) -> int:
    return (1 << n) - 1


def relative_error(b: int) -> float:
    """The largest width of a bin above the cutoff, relative to its values."""
    return 2.0**-b


def absolute_error(a: int) -> int:
    """The width of a bin below the cutoff."""
    return 1 << a
