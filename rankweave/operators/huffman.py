"""Huffman-shaped sequences: code tables, bit planes of the codes, and queries that walk down those planes.

The alphabet is counted by one partial aggregation. Code lengths depend on how many symbols have which weight
only: that list goes to the driver (n occurrences have fewer than sqrt(2 n) different counts). Everything that
has a row per symbol stays distributed: a symbol's rank by weight decides its length and, with the number of
codes of each length, the code itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.bitmath import select_in_word
from rankweave.functions.codes import grouped_code_lengths
from rankweave.operators.sequence import Sequence, coded_words
from rankweave.plans.index import SequenceIndex
from rankweave.plans.ranking import checked_broadcast, latest, with_ordinal
from rankweave.sources.scratch import scratch_folder


def _by_length(lengths: list[tuple[int, int]], value) -> Column:
    """A value for each code length, of ``lengths`` (length, how many), at most 64 of them."""
    out = F.lit(None).cast("long")
    for k, (n, _) in enumerate(lengths):
        out = F.when(F.col("len") == n, F.lit(value(k)).cast("long")).otherwise(out)
    return out


def _first_ranks(lengths: list[tuple[int, int]]) -> list[int]:
    return [sum(m for _, m in lengths[:k]) for k in range(len(lengths))]


def canonical(lengths: DataFrame) -> DataFrame:
    """``(rn, len, code)``: right-aligned canonical codes of ``lengths(rn, len)``, ascending by rn from 0.

    A code is the first one of its length plus the ranks since; how many codes have which length is all that
    must be known (at most 64 numbers).
    """
    counts = sorted((r["len"], r.m) for r in lengths.groupBy("len").agg(F.count("*").alias("m")).collect())
    return lengths.select("rn", "len", (_by_length(counts, _first_codes(counts).__getitem__) + F.col("rn") - _by_length(counts, _first_ranks(counts).__getitem__)).alias("code"))


def _first_codes(lengths: list[tuple[int, int]]) -> list[int]:
    out, code, last = [], 0, lengths[0][0] if lengths else 0
    for n, m in lengths:
        code <<= n - last
        out.append(code)
        code, last = code + m, n
    return out


def _level_code(lengths: list[tuple[int, int]]) -> Column:
    """The code that makes ended codes sort last at every level, by reversed bits; needs columns rn and len.

    At level l there are ``free[l]`` codes, in the order of their reversed bits: those that go on from the level
    before with a 0, then the same with a 1. Codes that end take the last places. So the place at the level
    where a code ends gives its last bit, and the place at the level before.
    """
    ended, free = dict(lengths), [1]
    longest = lengths[-1][0] if lengths else 0
    for n in range(1, longest + 1):
        free.append(2 * (free[-1] - ended.get(n - 1, 0)))
    place = F.col("rn") - _by_length(lengths, _first_ranks(lengths).__getitem__) + _by_length(lengths, lambda k: free[lengths[k][0]] - lengths[k][1])
    if not longest:
        return F.lit(0).cast("long")
    halves = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(free[n] // 2).cast("long").alias("half")) for n in range(longest, 0, -1)])

    def step(s: Column, level: Column) -> Column:
        one = (level["n"] <= F.col("len")) & (s["place"] >= level["half"])
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.col("len") - level["n"], F.lit(0)).cast("int"))
        return F.struct(F.when(one, s["place"] - level["half"]).otherwise(s["place"]).alias("place"), F.when(one, s["code"].bitwiseOR(bit)).otherwise(s["code"]).alias("code"))

    return F.aggregate(halves, F.struct(place.alias("place"), F.lit(0).cast("long").alias("code")), step, lambda s: s["code"])


def code_table(seq: DataFrame) -> DataFrame:
    """``(rn, symbol, weight, len, canonical, code, padded)``: one row per symbol, heaviest first (ties by symbol):
    code length, canonical and level code, and the level code padded with ones to the longest length. One
    symbol or none: length 0."""
    spark = seq.sparkSession
    freq = seq.groupBy(F.col("sym").alias("symbol")).agg(F.count("*").alias("weight"))
    top = freq.agg(F.coalesce(F.max("symbol"), F.lit(0)).alias("m")).first().m
    groups = sorted(((r.weight, r.m) for r in freq.groupBy("weight").agg(F.count("*").alias("m")).collect()), reverse=True)
    lengths = grouped_code_lengths(groups)
    heavier, placed = 0, []
    for weight, m in groups:
        placed.append((weight, heavier))
        heavier += m
    ranks = checked_broadcast(spark.createDataFrame(placed, "weight long, heavier long"))
    rows = with_ordinal(freq, top + 1, keys=("weight",), pos="symbol", out="nth").join(ranks, "weight").withColumn("rn", F.col("heavier") + F.col("nth"))
    length = F.lit(None).cast("long")
    for first, (n, _) in zip(_first_ranks(lengths)[::-1], lengths[::-1], strict=True):
        length = F.when((F.col("rn") >= first) & length.isNull(), F.lit(n).cast("long")).otherwise(length)
    rows = rows.withColumn("len", length)
    longest = lengths[-1][0] if lengths else 0
    whole = _by_length(lengths, _first_codes(lengths).__getitem__) + F.col("rn") - _by_length(lengths, _first_ranks(lengths).__getitem__)
    rows = rows.withColumns({"canonical": whole, "code": _level_code(lengths)})
    fill = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(longest) - F.col("len")).cast("int"))
    return rows.select("rn", "symbol", "weight", "len", "canonical", "code", (F.col("code") * fill + fill - 1).alias("padded"))


@dataclass
class HuffmanSequence:
    """A sequence, its code table, and the bit planes of its codes.

    A plane holds the bits of codes that reach its level; queries look up words of 32 bits and their ranks.
    Unseen symbols have count 0 and no positions.
    """

    codes: DataFrame
    planes: SequenceIndex

    @classmethod
    def build(cls, seq: DataFrame, path: str) -> HuffmanSequence:
        """Write code table and planes below path."""
        code_table(seq).write.mode("overwrite").parquet(f"{path}/codes")
        codes = seq.sparkSession.read.parquet(f"{path}/codes")
        lens = level_lens(codes)
        total = codes.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).first().n
        coded = seq.join(codes.select(F.col("symbol").alias("sym"), F.col("padded").alias("code"), "len"), "sym").select("pos", "code", "len")
        words = coded_words(coded, len(lens), total)
        words.repartitionByRange("level", "block").sortWithinPartitions("level", "block").write.partitionBy("level").mode("overwrite").parquet(f"{path}/planes")
        return cls(codes, SequenceIndex.read(seq.sparkSession, f"{path}/planes", total, lens))

    @property
    def spark(self) -> SparkSession:
        return self.codes.sparkSession

    def _bit(self, level: int) -> Column:
        """The bit of ``code`` at a level that the code reaches."""
        return F.call_function("shiftright", F.col("code"), F.greatest(F.col("len") - 1 - level, F.lit(0)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def _down(self, queries: DataFrame) -> DataFrame:
        """queries with their symbol's code and its interval ``lo, hi`` on the level where the code ends."""
        keep = [c for c in queries.columns if c not in ("lo", "hi")]
        clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(self.planes.length)).cast("long").alias(c)
        state = queries.join(self.codes.select("symbol", "code", "len"), "symbol", "left").select(*keep, "code", "len", clip("lo"), clip("hi"))
        for level in range(self.planes.levels):
            state = self.planes.step(state, level, self._bit(level), F.col("len") > level)
        return state

    def get(self, queries: DataFrame) -> DataFrame:
        """Symbol at ``at``; null outside the sequence."""
        p = self.planes
        state = queries.withColumns({"_p": F.when((F.col("at") >= 0) & (F.col("at") < p.length), F.col("at")), "code": F.lit(0).cast("long"), "len": F.lit(0).cast("long")})
        for level in range(p.levels):
            # a place beyond the plane belongs to a code that has ended
            on = F.coalesce(F.col("_p") < p.lens[level], F.lit(False)) & (F.col("len") == level)
            words = p.level(level).select(F.col("block").alias("_b"), F.col("word").alias("_w"), F.col("rank1").alias("_r"))
            state = state.withColumn("_b", F.shiftright("_p", 5)).join(words, "_b", "left")
            offset = F.col("_p").bitwiseAND(F.lit(31)).cast("int")
            one = F.call_function("shiftright", F.col("_w"), offset).bitwiseAND(F.lit(1)) == 1
            rank = F.col("_r") + F.bit_count(F.col("_w").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), offset) - 1))
            to = F.when(one, rank + p.zeros[level]).otherwise(F.col("_p") - rank)
            state = state.withColumns({"_p": F.when(on, to).otherwise(F.col("_p")), "code": F.when(on, F.col("code") * 2 + one.cast("long")).otherwise(F.col("code")), "len": F.when(on, F.lit(level + 1)).otherwise(F.col("len"))}).drop("_b", "_w", "_r")
        found = state.join(self.codes.select("code", "len", F.col("symbol").alias("sym")), ["code", "len"], "left")
        return found.withColumn("sym", F.when(F.col("_p").isNotNull(), F.col("sym"))).drop("_p", "code", "len")

    def count(self, queries: DataFrame) -> DataFrame:
        """queries with ``cnt``: occurrences of ``symbol`` in the range."""
        got = self._down(queries.select("qid", "lo", "hi", "symbol")).select("qid", F.when(F.col("len").isNull(), 0).otherwise(F.greatest(F.col("hi") - F.col("lo"), F.lit(0))).cast("long").alias("cnt"))
        return queries.join(got, "qid")

    def select(self, queries: DataFrame, *, last: bool = False) -> DataFrame:
        """``(qid, pos)``: position of the k-th occurrence of ``symbol`` in the range, from the left or the right.

        Down to the interval of the symbol, then up from one place in it, level by level; the state is written
        between levels, as every level needs it more than once.
        """
        place = F.col("hi") - 1 - F.col("k") if last else F.col("lo") + F.col("k")
        state = self._down(queries.select("qid", "lo", "hi", "symbol", "k"))
        ok = F.col("len").isNotNull() & (F.col("k") >= 0) & (place >= F.col("lo")) & (place < F.col("hi"))
        state = state.select("qid", "code", "len", F.when(ok, place).alias("p"))
        folder = scratch_folder(self.spark, "huffman-select")
        for level in range(self.planes.levels - 1, -1, -1):
            state.write.parquet(f"{folder}/{level}")
            state = self._up(self.spark.read.parquet(f"{folder}/{level}"), level)
        return queries.select("qid").join(state.select("qid", F.col("p").alias("pos")), "qid", "left")

    def _up(self, state: DataFrame, level: int) -> DataFrame:
        """state with the place ``p`` one level higher: the p-th zero or one of the level, where the code reaches it."""
        on = F.col("p").isNotNull() & (F.col("len") > level)
        words = self.planes.level(level)
        both = F.array(F.struct(F.lit(0).alias("bit"), (F.col("block") * 32 - F.col("rank1")).alias("begin")), F.struct(F.lit(1).alias("bit"), F.col("rank1").alias("begin")))
        begins = words.select("block", "word", "rank1", F.explode(both).alias("e")).select("block", "word", "rank1", "e.bit", "e.begin")
        asks = state.where(on).withColumn("bit", self._bit(level).cast("int")).withColumn("j", F.col("p") - F.when(F.col("bit") == 1, F.lit(self.planes.zeros[level])).otherwise(0))
        # of words that begin at the same rank only the last one holds bits
        held = latest(begins, asks, self.planes.length + 1, ["block", "word", "rank1"], keys=("bit",), value="begin", at="j")
        begin = F.when(F.col("bit") == 1, F.col("rank1")).otherwise(F.col("block") * 32 - F.col("rank1"))
        word = F.when(F.col("bit") == 1, F.col("word")).otherwise(F.bitwise_not(F.col("word")).bitwiseAND(F.lit(0xFFFFFFFF)))
        moved = held.select("qid", "code", "len", (F.col("block") * 32 + select_in_word(word, F.col("j") - begin)).alias("p"))
        return moved.union(state.where(~on).select("qid", "code", "len", "p"))

    def simple_majority(self, queries: DataFrame) -> DataFrame:
        """``(qid, symbol)``: the symbol of more than half of the range, or null: always towards the fuller side."""
        p = self.planes
        clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(p.length)).cast("long")
        state = queries.select("qid", clip("lo").alias("lo"), clip("hi").alias("hi"), (clip("hi") - clip("lo")).alias("_size"), F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("len"))
        for level in range(p.levels):
            on = (F.col("len") == level) & (F.col("lo") < p.lens[level])
            ones = F.col("r_hi") - F.col("r_lo")
            state = p.ranks(state, level).withColumn("_one", 2 * ones > F.col("hi") - F.col("lo")).withColumn("_on", on)
            state = p.turn(state, level, F.col("_one"), F.col("_on"))
            state = state.withColumns({"code": F.when(F.col("_on"), F.col("code") * 2 + F.col("_one").cast("long")).otherwise(F.col("code")), "len": F.when(F.col("_on"), F.lit(level + 1)).otherwise(F.col("len"))}).drop("_on", "_one")
        found = state.join(self.codes.select("code", "len", "symbol"), ["code", "len"], "left")
        return found.select("qid", F.when(2 * (F.col("hi") - F.col("lo")) > F.col("_size"), F.col("symbol")).alias("symbol"))

    def stats(self) -> DataFrame:
        return self.codes.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("len"), F.coalesce(F.max("symbol"), F.lit(0)).alias("max_symbol"), F.coalesce(F.max("len"), F.lit(0)).alias("num_levels"), F.count("*").alias("num_symbols"))

    def level_lens(self) -> DataFrame:
        """``(level, len)``: symbols of the sequence whose code is longer than the level."""
        return self.spark.createDataFrame([(k, n) for k, n in enumerate(self.planes.lens)], "level long, len long")


def level_lens(codes: DataFrame) -> list[int]:
    """How many symbols of the sequence have a code longer than each level (at most 64 numbers)."""
    held = {r["len"]: r.w for r in codes.groupBy("len").agg(F.sum("weight").alias("w")).collect()}
    return [sum(w for n, w in held.items() if n > level) for level in range(max(held, default=0))]


def encoded(sequence: Sequence, codes: DataFrame) -> DataFrame:
    """``(pos, padded)``: the sequence in padded level codes."""
    return sequence.seq.join(codes.select(F.col("symbol").alias("sym"), "padded"), "sym").select("pos", "padded")
