"""Bytes that each packed form of a set, multiset or sequence takes, by its layout (contents, without headers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.bits import BitSet, MultiSet
from rankweave.operators.sequence import Sequence


def words(bits: Column) -> Column:
    """Bytes of so many bits in words of 64."""
    return (F.floor((bits + 63) / 64) * 8).cast("long")


def byte_sizes(bits: BitSet, width: int = 32) -> DataFrame:
    """One row: the set as a bit buffer, under a rank directory (a 32-bit sum per 1,024 positions), as an array of
    32-bit positions, split into high and low parts, as runs (two 32-bit sums each); and integers of the
    given width, one per position."""
    n = F.lit(bits.universe).cast("long")
    stats = bits.ones.agg(F.count("*").alias("c"), F.min("pos").alias("off"))
    shape = bits.elias_fano().agg(F.first("low_bits").alias("l"))
    runs = bits.runs().agg(F.count("*").alias("r"))
    one = stats.join(shape).join(runs)  # one row each
    c, low = F.coalesce("c", F.lit(0)), F.coalesce("l", F.lit(0))
    high = F.call_function("shiftright", n - F.coalesce("off", n), low.cast("int"))
    return one.select(
        words(n).alias("bit_buffer"), (words(n) + F.floor((n + 1023) / 1024) * 4).cast("long").alias("dense"), (c * 4).alias("array"),
        (words(c * low) + words(c + high + 1)).cast("long").alias("sparse"), (F.col("r") * 8).alias("run_length"), words(n * width).alias("int_buffer"),
    )


def multi_byte_size(multi: MultiSet) -> DataFrame:
    """``(occupied, sums)``: the positions as a bit buffer, and a 32-bit running count for each."""
    return multi.counts.agg((F.count("*") * 4).alias("sums")).select(words(F.lit(multi.universe).cast("long")).alias("occupied"), "sums")


def padded_byte_size(bits: BitSet) -> DataFrame:
    """``(padded)``: the 32-bit blocks that stay when padding at the ends is implied."""
    return bits.trimmed().select((F.greatest(F.col("right") - F.col("left"), F.lit(0)) * 4).alias("padded"))


def sequence_byte_size(sequence: Sequence) -> int:
    """Bit planes in words of 32 bits, each with the 32-bit sum of ones before it."""
    return sequence.levels * -(-sequence.length // 32) * 8


def coded_byte_size(level_lens: DataFrame, codes: DataFrame) -> DataFrame:
    """``(planes, tables)`` of a prefix-coded sequence: planes as above, only as long as codes last; two maps
    between symbols and codes (two 32-bit entries each)."""
    planes = level_lens.agg(F.coalesce(F.sum(F.floor((F.col("len") + 31) / 32) * 8), F.lit(0)).cast("long").alias("planes"))
    return planes.join(codes.agg((F.count("*") * 16).alias("tables")))
