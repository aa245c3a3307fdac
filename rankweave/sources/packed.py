"""Packed forms: bit buffers and fixed-width integers in 64-bit words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_words(ones: DataFrame) -> DataFrame:
    """``(block, word)``: bit ``pos & 63`` of word ``pos >> 6`` is set; blocks without ones are absent."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(F.lit(63)).cast("int"))
    return ones.groupBy(F.shiftright("pos", 6).alias("block")).agg(F.bit_or(bit).alias("word"))


def from_words(words: DataFrame) -> DataFrame:
    """``(pos)`` of the set bits."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("word", i) == 1)
    return words.select(F.shiftleft("block", 6).alias("base"), F.explode(bits).alias("bit")).select((F.col("base") + F.col("bit")).alias("pos"))


def pack_integers(rows: DataFrame, width: int) -> DataFrame:
    """``(block, n, words)``: 64 values of ``rows(pos, value)`` in ``width`` words, lowest bits first.

    n is one more than the last position held. A value that does not fit is an error; missing positions read as 0.
    """
    if not 0 <= width <= 56:
        raise ValueError("the width must be from 0 to 56 bits")
    value = F.when(F.col("value").between(0, (1 << width) - 1), F.col("value")).otherwise(F.raise_error(F.concat(F.col("value").cast("string"), F.lit(f" does not fit {width} bits"))))
    entry = F.struct(F.col("pos").bitwiseAND(F.lit(63)).cast("int").alias("k"), value.cast("long").alias("v"))
    held = rows.groupBy(F.shiftright("pos", 6).alias("block")).agg(F.max(F.col("pos").bitwiseAND(F.lit(63)) + 1).cast("int").alias("n"), F.collect_list(entry).alias("m"))
    up, down = (lambda c, k: F.call_function("shiftleft", c, k)), (lambda c, k: F.call_function("shiftright", c, k))

    def word(w: Column) -> Column:
        first = lambda e: e["k"] * width - w * 64  # noqa: E731  where a value's lowest bit lies, seen from this word

        def take(acc: Column, e: Column) -> Column:
            at = first(e)
            part = F.when(at >= 0, up(e["v"], F.greatest(at, F.lit(0)))).otherwise(down(e["v"], F.greatest(-at, F.lit(0))))
            return F.when((at > -width) & (at < 64), acc.bitwiseOR(part)).otherwise(acc)

        return F.aggregate("m", F.lit(0).cast("long"), take)

    words = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), word) if width else F.array().cast("array<bigint>")
    return held.select("block", "n", words.alias("words"))


def unpack_integers(packed: DataFrame, width: int) -> DataFrame:
    """``(pos, value)`` of what pack_integers wrote."""
    at = packed.select("block", "words", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    bit = F.col("k") * width
    word, offset = F.shiftright(bit, 6), bit.bitwiseAND(F.lit(63))
    low = F.call_function("shiftrightunsigned", F.get("words", word), offset)
    high = F.when(offset + width > 64, F.call_function("shiftleft", F.get("words", word + 1), 64 - offset)).otherwise(F.lit(0).cast("long"))
    value = low.bitwiseOR(high).bitwiseAND(F.lit((1 << width) - 1)) if width else F.lit(0).cast("long")
    return at.select((F.col("block") * 64 + F.col("k")).alias("pos"), value.alias("value"))
