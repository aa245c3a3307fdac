"""Rows that surely have no partner are told apart before a shuffle, by a table of bits of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the table: 4 MB in rows of 4,096, so its broadcast is bounded.
FILTER_BITS = 1 << 25


def _places(key: Column) -> tuple[Column, Column, Column]:
    """Row, word of the row, and bit of the word that stand for a key."""
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return F.shiftright(slot, 12), F.shiftright(slot, 6).bitwiseAND(F.lit(63)).cast("int"), slot.bitwiseAND(F.lit(63)).cast("int")


def perhaps(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, out: str) -> DataFrame:
    """rows with a boolean ``out``: false where the key is surely not among the wanted keys, true for all others.

    A bit is set for each wanted key. With very many of them the table fills up and rules fewer rows out; it
    never rules out a wanted one. Names: ``out`` and ``_row``, ``_held`` must be free in rows.
    """
    row, word, bit = _places(wanted_key)
    words = wanted.groupBy(row.alias("_row"), word.alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("v"))
    held = words.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    held = held.select("_row", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long"))).alias("_held"))
    row, word, bit = _places(key)
    found = rows.withColumn("_row", row).join(F.broadcast(held), "_row", "left")
    return found.withColumn(out, F.coalesce(F.getbit(F.get("_held", word), bit) == 1, F.lit(False))).drop("_row", "_held")
