"""Bit sets packed into words under a rank directory, and rank and select that read only those.

One row stands for a block of ``2**pow2`` positions that holds any one: its words of 64 bits (an array), its
ones, and the ones before it. A query looks up one row by an equi-join and counts bits inside the words, so
the positions themselves are not touched again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.bitmath import one_mask, popcount, select_in_word
from rankweave.operators.bits import BitSet
from rankweave.plans.ranking import latest, running_blocks


@dataclass
class DenseSet:
    """``packed(block, words, ones, prefix)`` of a set in ``[0, universe)``; pow2 is from 6 to 16."""

    packed: DataFrame
    universe: int
    pow2: int

    @classmethod
    def build(cls, bits: BitSet, pow2: int = 10) -> DenseSet:
        """One shuffle of words: each task combines the positions of a block before it hands them on."""
        if not 6 <= pow2 <= 16:
            raise ValueError("pow2 must be from 6 to 16")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(F.lit(63)).cast("int"))
        words = bits.ones.groupBy(F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
        n = 1 << (pow2 - 6)
        held = words.groupBy(F.shiftright("word", pow2 - 6).alias("_b")).agg(
            F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(n - 1)).cast("int").alias("k"), "bits"))).alias("m"), F.sum(popcount(F.col("bits"))).alias("_c")
        )
        dense = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long")))
        table = held.select("_b", dense.alias("words"), "_c")
        placed = running_blocks(table.select("_b", "_c"), (), bits.universe >> pow2)
        return cls(table.drop("_c").join(placed, "_b").select(F.col("_b").alias("block"), "words", F.col("_c").alias("ones"), F.coalesce("_s", F.lit(0)).alias("prefix")), bits.universe, pow2)

    def written(self, path: str) -> DenseSet:
        """The same set, stored at path and read from there."""
        self.packed.repartitionByRange("block").sortWithinPartitions("block").write.parquet(path)
        return DenseSet.read(self.packed.sparkSession, path, self.universe, self.pow2)

    @classmethod
    def read(cls, spark: SparkSession, path: str, universe: int, pow2: int) -> DenseSet:
        return cls(spark.read.parquet(path), universe, pow2)

    def rank1(self, queries: DataFrame, out: str = "rank1") -> DataFrame:
        """Ones below ``at`` for ``queries(qid, at)``: those of earlier blocks, then bits of the own block."""
        place = F.greatest(F.least(F.col("at"), F.lit(self.universe)), F.lit(0)).cast("long")
        asks = queries.withColumns({"_b": F.shiftright(place, self.pow2), "_i": place.bitwiseAND(F.lit((1 << self.pow2) - 1)).cast("int")})
        # the own block, or the last one before it
        found = latest(self.packed, asks, (self.universe >> self.pow2) + 1, ["block", "prefix", "ones"], value="block", at="_b")
        found = found.join(self.packed.select("block", "words"), "block", "left")
        word = F.shiftright("_i", 6)
        whole = F.aggregate(F.slice("words", 1, word), F.lit(0).cast("long"), lambda s, w: s + popcount(w))
        part = popcount(F.get("words", word).bitwiseAND(one_mask(F.col("_i").bitwiseAND(F.lit(63)))))
        inside = F.when(F.col("block") == F.col("_b"), whole + part).otherwise(F.col("ones"))
        return found.withColumn(out, F.coalesce(F.col("prefix") + inside, F.lit(0))).select(*queries.columns, out)

    def select1(self, queries: DataFrame, out: str = "pos") -> DataFrame:
        """Position of the k-th one (0-based) for ``queries(qid, k)``; null if there are fewer."""
        held = latest(self.packed, queries.where("k >= 0").select("qid", "k"), self.universe, ["block", "ones", "prefix"], value="prefix", at="k").where("k < prefix + ones")
        rows = held.join(self.packed.select("block", "words"), "block")
        # walk the words until the one that holds the bit: (bits still to pass, number of the word)
        start = F.struct((F.col("k") - F.col("prefix")).alias("left"), F.lit(0).alias("word"), F.lit(False).alias("done"))

        def step(s: Column, w: Column) -> Column:
            stop = s["done"] | (s["left"] < popcount(w))
            return F.struct(F.when(stop, s["left"]).otherwise(s["left"] - popcount(w)).alias("left"), F.when(stop, s["word"]).otherwise(s["word"] + 1).alias("word"), stop.alias("done"))

        at = F.aggregate("words", start, step)
        rows = rows.withColumn("_at", at)
        bit = select_in_word(F.element_at("words", F.col("_at.word") + 1), F.col("_at.left"))
        found = rows.select("qid", "k", (F.shiftleft("block", self.pow2) + F.col("_at.word") * 64 + bit).alias(out))
        return queries.join(found, ["qid", "k"], "left")
