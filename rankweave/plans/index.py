"""A persisted index of a sequence, and batch queries that descend it level by level.

The index is the bit planes in words with their rank prefixes (one row per 32 bits and level). A batch of
queries walks down together: on each level both ends of every range look up one word by an equi-join on
its number, so a query costs two lookups per level however long its range is, and no query meets the
sequence itself. This is the plan for very many queries; a few are cheaper by one scan (see
``operators.sequence``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators.bits import BitSet
from rankweave.operators.sequence import Sequence, plane_words
from rankweave.plans.planes import word_tasks
from rankweave.plans.ranking import is_small


@dataclass
class SequenceIndex:
    """``words(level, block, word, rank1)`` of a sequence, its length, and for each level its bits and its zeros."""

    words: DataFrame
    length: int
    lens: list[int]
    zeros: list[int]

    @property
    def levels(self) -> int:
        return len(self.lens)

    @classmethod
    def build(cls, sequence: Sequence, path: str) -> SequenceIndex:
        """Write the index, a folder per level and each sorted by word number, so that a lookup prunes the
        files of other levels and row groups of other blocks."""
        words = sequence.level_words()
        cls._write(words, sequence.levels, sequence.length, path)
        return cls.read(words.sparkSession, path, sequence.length, [sequence.length] * sequence.levels)

    @classmethod
    def from_planes(cls, planes: list[BitSet], path: str) -> SequenceIndex:
        """From ready bit planes, top level first, all of the same universe (the length of the sequence)."""
        length = planes[0].universe if planes else 0
        spread = [p.ones.select(F.lit(k).cast("long").alias("level"), F.col("pos").alias("idx"), F.lit(1).cast("long").alias("bit")) for k, p in enumerate(planes)]
        # a zero at every word's first bit keeps words without ones
        spread += [p.ones.sparkSession.range(0, length, 32).select(F.lit(k).cast("long").alias("level"), F.col("id").alias("idx"), F.lit(0).cast("long").alias("bit")) for k, p in enumerate(planes)]
        words = plane_words(reduce(DataFrame.unionAll, spread), len(planes), length)
        cls._write(words, len(planes), length, path)
        return cls.read(words.sparkSession, path, length, [length] * len(planes))

    @staticmethod
    def _write(words: DataFrame, levels: int, length: int, path: str) -> None:
        """By as many tasks as the number of words asks for, whatever the session's partitions are."""
        dealt = words.repartitionByRange(word_tasks(levels, length), "level", "block")
        dealt.sortWithinPartitions("level", "block").write.mode("overwrite").partitionBy("level").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, length: int, lens: list[int]) -> SequenceIndex:
        if not length or not lens:
            return cls(spark.createDataFrame([], "block long, word long, rank1 long, level int"), length, lens, [0] * len(lens))
        words = spark.read.parquet(path)
        # one row per level: the last word's prefix and bits give its ones
        last = words.groupBy("level").agg(F.max(F.struct("block", "rank1", "word")).alias("m")).collect()
        ones = {int(r.level): r.m.rank1 + int(r.m.word).bit_count() for r in last}
        return cls(words, length, lens, [n - ones.get(k, 0) for k, n in enumerate(lens)])

    def level(self, level: int) -> DataFrame:
        """``(block, word, rank1)`` of one level."""
        return self.words.where(F.col("level") == level).select("block", "word", "rank1")

    def ranks(self, state: DataFrame, level: int, few: bool = False) -> DataFrame:
        """state with ``r_lo, r_hi``: ones of the level below each end.

        few: state is small and travels to the words (every end then asks a word that is there), which are neither
        shuffled nor gathered.
        """
        words = self.level(level)
        ones = self.lens[level] - self.zeros[level]
        few = few and self.lens[level] > 0
        for end in ("lo", "hi"):
            found = words.select(F.col("block").alias("_b"), F.col("word").alias("_w"), F.col("rank1").alias("_r"))
            below = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(end).bitwiseAND(F.lit(31)).cast("int")) - 1
            rank = F.col("_r") + F.bit_count(F.col("_w").bitwiseAND(below))
            block = F.shiftright(end, 5)
            if few:
                held = F.coalesce((F.col(end) >= 0) & (F.col(end) < self.lens[level]), F.lit(False))
                state = F.broadcast(state.withColumn("_b", F.when(held, block).otherwise(F.lit(0)).cast("long"))).join(found, "_b")
                rank = F.when(held, rank)
            else:
                state = state.withColumn("_b", block).join(found, "_b", "left")
            state = state.withColumn(f"r_{end}", F.coalesce(rank, F.lit(ones)).cast("long")).drop("_b", "_w", "_r")
        return state

    def turn(self, state: DataFrame, level: int, right: Column, on: Column | None = None) -> DataFrame:
        """The ends of the range one level lower, to the right or left; where ``on`` is false they stay."""
        lo = F.when(right, F.lit(self.zeros[level]) + F.col("r_lo")).otherwise(F.col("lo") - F.col("r_lo"))
        hi = F.when(right, F.lit(self.zeros[level]) + F.col("r_hi")).otherwise(F.col("hi") - F.col("r_hi"))
        if on is not None:
            lo, hi = F.when(on, lo).otherwise(F.col("lo")), F.when(on, hi).otherwise(F.col("hi"))
        return state.withColumns({"lo": lo, "hi": hi}).drop("r_lo", "r_hi")

    def step(self, state: DataFrame, level: int, right: Column, on: Column) -> DataFrame:
        return self.turn(self.ranks(state, level), level, right, on)

    def get(self, queries: DataFrame) -> DataFrame:
        """Symbol at ``at``, put together from the planes; null outside the sequence."""
        asks = queries.withColumns({"_at": F.col("at"), "lo": F.col("at"), "hi": F.col("at") + 1, "k": F.lit(0).cast("long")}).where((F.col("at") >= 0) & (F.col("at") < self.length))
        return queries.join(self.quantile(asks).select("qid", F.col("symbol").alias("sym")), "qid", "left")

    def quantile(self, queries: DataFrame) -> DataFrame:
        """``(qid, k, symbol, cnt)`` for ``queries(qid, lo, hi, k)``, as ``Sequence.quantile``."""
        end = F.least("hi", F.lit(self.length))
        state = queries.select("qid", F.col("k").alias("asked"), "lo", end.alias("hi"), "k", F.lit(0).cast("long").alias("symbol")).where("k >= 0 AND k < hi - lo")
        few = is_small(queries)
        for level in range(self.levels):
            state = self.ranks(state, level, few)
            zeros = (F.col("hi") - F.col("r_hi")) - (F.col("lo") - F.col("r_lo"))
            state = state.withColumn("_right", F.col("k") >= zeros)
            state = state.withColumns({"k": F.when(F.col("_right"), F.col("k") - zeros).otherwise(F.col("k")), "symbol": F.col("symbol") + F.when(F.col("_right"), F.lit(1 << (self.levels - 1 - level))).otherwise(0)})
            state = self.turn(state, level, F.col("_right")).drop("_right")
        return state.select("qid", F.col("asked").alias("k"), "symbol", (F.col("hi") - F.col("lo")).alias("cnt"))

    def count(self, queries: DataFrame) -> DataFrame:
        """``(qid, preceding, cnt)`` of ``symbol`` in each range of ``queries(qid, lo, hi, symbol)``."""
        top = (1 << self.levels) - 1
        state = queries.select("qid", F.least("lo", F.lit(self.length)).alias("lo"), F.least("hi", F.lit(self.length)).alias("hi"), "symbol", F.lit(0).cast("long").alias("preceding"))
        state = state.withColumn("_size", F.col("hi") - F.col("lo"))
        few = is_small(queries)
        for level in range(self.levels):
            state = self.ranks(state, level, few)
            right = F.col("symbol").bitwiseAND(F.lit(1 << (self.levels - 1 - level))) != 0
            zeros = (F.col("hi") - F.col("r_hi")) - (F.col("lo") - F.col("r_lo"))
            state = state.withColumn("preceding", F.col("preceding") + F.when(right, zeros).otherwise(0))
            state = self.turn(state, level, right)
        beyond = F.col("symbol") > top  # larger than any symbol the levels can hold
        return state.select("qid", F.when(beyond, F.col("_size")).otherwise(F.col("preceding")).alias("preceding"), F.when(beyond, 0).otherwise(F.col("hi") - F.col("lo")).cast("long").alias("cnt"))
