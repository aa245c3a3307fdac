"""Rank, select and membership on integer sets and multisets.

A set is a table of distinct positions, a multiset of positions with counts; both have a universe size.
Queries are tables keyed by ``qid`` and are answered together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.plans.ranking import block_bits, block_table, checked_broadcast, count_below, kth_value, latest, running_blocks, with_ordinal


@dataclass
class BitSet:
    """``ones(pos)`` in a universe of ``[0, universe)``."""

    ones: DataFrame
    universe: int

    @classmethod
    def build(cls, positions: DataFrame, universe: int, *, strict: bool = True) -> BitSet:
        """From positions in any order, with repeats. strict: a position outside the universe is an error."""
        pos = F.col("pos")
        ok = (pos >= 0) & (pos < universe)
        rows = positions.select(F.when(ok, pos).otherwise(F.raise_error(F.concat(F.lit("position outside the universe: "), pos.cast("string")))).alias("pos")) if strict else positions.where(ok)
        return cls(rows.select(F.col("pos").cast("long").alias("pos")).distinct(), universe)

    def rank1(self, queries: DataFrame, out: str = "rank1") -> DataFrame:
        """Ones below ``at``, for ``queries(qid, at)``; beyond the universe, all of them."""
        return count_below(self.ones, queries, self.universe, out=out)

    def rank0(self, queries: DataFrame, out: str = "rank0") -> DataFrame:
        """Zeros below ``at``."""
        return self.rank1(queries, "_r1").withColumn(out, F.least(F.col("at"), F.lit(self.universe)) - F.col("_r1")).drop("_r1")

    def ranks(self, queries: DataFrame) -> DataFrame:
        """Both ranks in one pass."""
        return self.rank1(queries).withColumn("rank0", F.least(F.col("at"), F.lit(self.universe)) - F.col("rank1"))

    def select1(self, queries: DataFrame, out: str = "pos") -> DataFrame:
        """Position of the k-th one (0-based) for ``queries(qid, k)``; null if there are fewer."""
        return kth_value(self.ones, queries, self.universe, total=self.universe, out=out)

    def select0(self, queries: DataFrame, out: str = "pos") -> DataFrame:
        """Position of the k-th zero (0-based): k plus the ones before it.

        Those are the ones of whole blocks, and, where the zero lies in a block that has ones, the ones of
        that block with at most as many zeros before them.
        """
        bits = block_bits(self.universe)
        start = F.shiftleft("_b", bits)
        table = block_table(self.ones, self.universe).withColumn("_z", start - F.col("_s"))
        held = latest(table, queries.where("k >= 0").select("qid", "k"), self.universe + 1, ["_b", "_c", "_s"], value="_z", at="k").where("_b IS NOT NULL")
        held = held.withColumn("_v", F.col("k") - start + F.col("_s"))  # zeros of the block before the one sought
        inside = held.where(F.col("_v") < F.lit(1 << bits) - F.col("_c")).select("qid", "k", "_b", "_v")
        beyond = held.where(F.col("_v") >= F.lit(1 << bits) - F.col("_c")).select("qid", "k", (F.col("k") + F.col("_s") + F.col("_c")).alias("_p"))
        near = self.ones.withColumn("_b", F.shiftright("pos", bits)).join(checked_broadcast(inside.select("_b").distinct()), "_b", "left_semi")
        nth = F.count("*").over(Window.partitionBy("_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        data = near.select("_b", (F.col("pos") - start - nth).alias("_v"), F.lit(0).alias("_ask"))
        rows = data.unionByName(inside.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
        ones = F.sum(1 - F.col("_ask")).over(Window.partitionBy("_b").orderBy("_v", "_ask").rowsBetween(Window.unboundedPreceding, 0))
        found = rows.withColumn("_o", ones).where("_ask = 1").select("qid", "k", (start + F.col("_v") + F.col("_o")).alias("_p"))
        # a zero before every one stands at k
        out_of = queries.join(found.union(beyond), ["qid", "k"], "left").withColumn("_p", F.coalesce("_p", F.when(F.col("k") >= 0, F.col("k"))))
        return out_of.withColumn(out, F.when(F.col("_p") < self.universe, F.col("_p"))).drop("_p")

    def all_ones_from(self) -> DataFrame:
        """``(all_ones_from)``, one row: from where on there are only ones (the universe, if its last position is a zero)."""
        zeros = self.ones.agg((F.lit(self.universe) - F.count("*")).alias("zeros")).select(F.lit(0).alias("qid"), (F.col("zeros") - 1).alias("k"))
        return self.select0(zeros).select(F.coalesce(F.col("pos") + 1, F.lit(0)).cast("long").alias("all_ones_from"))

    def get(self, queries: DataFrame) -> DataFrame:
        """1 or 0 for ``queries(qid, at)``; null outside the universe."""
        hit = queries.join(self.ones.select(F.col("pos").alias("at"), F.lit(1).cast("long").alias("_hit")), "at", "left")
        return hit.withColumn("bit", F.when((F.col("at") >= 0) & (F.col("at") < self.universe), F.coalesce("_hit", F.lit(0)))).drop("_hit")

    def stats(self) -> DataFrame:
        n = F.count("*").alias("num_ones")
        return self.ones.agg(n).select(F.lit(self.universe).cast("long").alias("universe"), "num_ones", (F.lit(self.universe) - F.col("num_ones")).cast("long").alias("num_zeros"))

    def in_range(self, lo: int | Column, hi: int | Column) -> DataFrame:
        """Ones in ``[lo, hi)``; the order is the reader's to ask for."""
        return self.ones.where((F.col("pos") >= lo) & (F.col("pos") < hi))

    def padded(self, left: int, right: int) -> BitSet:
        """With zeros before and after."""
        return BitSet(self.ones.select((F.col("pos") + left).alias("pos")), left + self.universe + right)

    def rank1_with_tail(self, queries: DataFrame, total: int) -> DataFrame:
        """rank1 when everything from this universe up to total is a one: the tail is arithmetic, not rows."""
        inner = queries.withColumn("_at", F.col("at")).withColumn("at", F.least("at", F.lit(self.universe)))
        tail = F.greatest(F.least(F.col("_at"), F.lit(total)) - self.universe, F.lit(0))
        return self.rank1(inner, "_r").withColumn("rank1", F.col("_r") + tail).withColumn("at", F.col("_at")).drop("_r", "_at")

    def select1_with_tail(self, queries: DataFrame, total: int) -> DataFrame:
        ones = self.ones.agg(F.count("*").alias("_n"))
        found = F.col("k") - F.col("_n") + self.universe
        return self.select1(queries, "_p").join(F.broadcast(ones)).withColumn("pos", F.coalesce("_p", F.when((F.col("k") >= F.col("_n")) & (found < total), found))).drop("_p", "_n")

    # -- physical forms ---------------------------------------------------------------------------

    def directory(self, pow2: int = 10) -> DataFrame:
        """``(block, ones, prefix)``: ones in each block of 2**pow2 positions that has any, and before it."""
        counts = self.ones.groupBy(F.shiftright("pos", pow2).alias("_b")).agg(F.count("*").alias("_c"))
        return running_blocks(counts, (), self.universe >> pow2).select(F.col("_b").alias("block"), F.col("_c").alias("ones"), F.coalesce("_s", F.lit(0)).alias("prefix"))

    def trimmed(self, threshold: float = 1.0) -> DataFrame:
        """``(padding, left, right, blocks)``, one row: the 32-bit blocks ``[left, right)`` that need be kept when
        leading and trailing blocks of zeros, or of ones, are implied - whichever leaves fewer (zeros on a
        tie). padding is null, and everything kept, if more than ``threshold`` of the blocks would stay."""
        n = -(-self.universe // 32)
        blocks = self.ones.groupBy(F.shiftright("pos", 5).alias("block")).agg(F.count("*").alias("ones"))
        # blocks that are not held are all zeros, so a run of full blocks at either end is what ones can imply
        full = F.when(F.col("block") == n - 1, self.universe - 32 * (n - 1)).otherwise(32)
        edge = blocks.where(F.col("ones") == full).select("block")
        lead = with_ordinal(edge, n + 1, pos="block", out="k").agg(F.count_if(F.col("block") == F.col("k")).alias("lead"))
        tail = with_ordinal(edge.select((F.lit(n - 1) - F.col("block")).alias("block")), n + 1, pos="block", out="k").agg(F.count_if(F.col("block") == F.col("k")).alias("tail"))
        shape = blocks.agg(F.min("block").alias("lo"), (F.max("block") + 1).alias("hi")).join(lead).join(tail)  # one row each
        zero = F.struct(F.coalesce("lo", F.lit(n)).alias("left"), F.coalesce("hi", F.lit(min(n, 1))).alias("right"))
        one = F.struct(F.col("lead").alias("left"), F.greatest(F.lit(n) - F.col("tail"), F.lit(min(n, 1))).alias("right"))
        size = lambda c: F.greatest(c["right"] - c["left"], F.lit(0))
        best = shape.select(F.when(size(zero) <= size(one), 0).otherwise(1).alias("padding"), zero.alias("z"), one.alias("o"))
        best = best.withColumn("kept", F.when(F.col("padding") == 0, F.col("z")).otherwise(F.col("o")))
        ok = size(F.col("kept")) <= threshold * n
        take = lambda c, other: F.when(ok, F.col(f"kept.{c}")).otherwise(other).cast("long").alias(c)
        return best.select(F.when(ok, F.col("padding")).cast("long").alias("padding"), take("left", 0), take("right", n), F.lit(n).cast("long").alias("blocks"))

    def elias_fano(self, low_bits: int | None = None) -> DataFrame:
        """``(idx, high, low, high_pos)`` with the offset and the width of the low part in every row; low_bits sets
        that width (0 to 56), which otherwise follows from how thinly the ones are spread."""
        stats = self.ones.agg(F.min("pos").alias("offset"), F.count("*").alias("n"))
        spread = F.floor((F.lit(self.universe) - F.col("offset")) / F.col("n")).cast("long")
        width = F.when(spread >= 1, F.least(F.length(F.bin(spread)) - 1, F.lit(56))).otherwise(0).cast("int") if low_bits is None else F.lit(low_bits)
        rows = with_ordinal(self.ones, self.universe, out="idx").join(F.broadcast(stats.select("offset", width.alias("low_bits"))))
        rel = F.col("pos") - F.col("offset")
        high = F.call_function("shiftright", rel, F.col("low_bits"))
        low = rel - F.call_function("shiftleft", high, F.col("low_bits"))
        return rows.select("idx", "offset", F.col("low_bits").cast("long").alias("low_bits"), high.alias("high"), low.alias("low"), (F.col("idx") + high).alias("high_pos"))

    def elias_fano_select1(self, queries: DataFrame) -> DataFrame:
        """select1 from the encoded parts."""
        back = F.col("offset") + F.call_function("shiftleft", F.col("high"), F.col("low_bits").cast("int")) + F.col("low")
        return queries.join(self.elias_fano().select(F.col("idx").alias("k"), back.alias("pos")), "k", "left")

    def elias_fano_rank1(self, queries: DataFrame) -> DataFrame:
        """rank1 from the encoded parts: ones with smaller high parts, then those of the same high part with
        smaller low parts."""
        coded = self.elias_fano()
        shape = coded.agg(F.first("offset").alias("offset"), F.first("low_bits").cast("int").alias("low_bits"))
        rel = F.greatest(F.col("at") - F.col("offset"), F.lit(0))
        high = F.call_function("shiftright", rel, F.col("low_bits"))
        asks = queries.join(F.broadcast(shape)).select("qid", "at", F.coalesce(high, F.lit(0)).alias("_high"), F.coalesce(rel - F.call_function("shiftleft", high, F.col("low_bits")), F.lit(0)).alias("_rest"))
        below = count_below(coded, asks, self.universe + 1, value="high", at="_high", out="_whole")
        same = below.join(coded.select(F.col("high").alias("_high"), "low"), "_high", "left").groupBy("qid", "at", "_whole").agg(F.count_if(F.col("low") < F.col("_rest")).alias("_part"))
        return same.select("qid", "at", (F.col("_whole") + F.col("_part")).alias("rank1"))

    def runs(self) -> DataFrame:
        """``(run, start, length, z, zo)``: maximal runs of ones in order, zeros before each (z) and all bits
        through its end (zo)."""
        gaps = with_ordinal(self.ones, self.universe).withColumn("z", F.col("pos") - F.col("ordinal"))
        runs = gaps.groupBy("z").agg(F.min("pos").alias("start"), F.count("*").alias("length"))
        return with_ordinal(runs, self.universe, pos="start", out="run").select("run", "start", "length", "z", (F.col("start") + F.col("length")).alias("zo"))

    @classmethod
    def from_runs(cls, parts: DataFrame) -> BitSet:
        """From ``parts(part, zeros, ones)``: in order of part (from 0), so many zeros and then so many ones. The
        universe is the sum of all; empty parts and adjoining runs make no difference."""
        total = parts.agg(F.coalesce(F.sum(F.col("zeros") + F.col("ones")), F.lit(0)).alias("u"), F.coalesce(F.max("part"), F.lit(0)).alias("m")).first()
        placed = with_ordinal(parts.withColumn("_w", F.col("zeros") + F.col("ones")), total.m + 1, pos="part", weight="_w", out="_first")
        ones = placed.where("ones > 0").select(F.explode(F.sequence(F.col("_first") + F.col("zeros"), F.col("_first") + F.col("_w") - 1)).alias("pos"))
        return cls(ones.select(F.col("pos").cast("long").alias("pos")), total.u)

    def runs_rank1(self, queries: DataFrame) -> DataFrame:
        """rank1 from the runs alone: whole runs that start below ``at`` less what lies beyond it."""
        # the last run that starts below `at`: its bits through the end, less the zeros, and what lies beyond `at`
        last = latest(self.runs(), queries.withColumn("_last", F.col("at") - 1), self.universe, ["z", "zo"], value="start", at="_last")
        over = F.greatest(F.col("zo") - F.col("at"), F.lit(0))
        return last.withColumn("rank1", F.when(F.col("at") > 0, F.coalesce(F.col("zo") - F.col("z") - over, F.lit(0))).otherwise(0)).drop("_last", "z", "zo")

    def runs_select(self, queries: DataFrame, ones: bool = True) -> DataFrame:
        """select1 or select0 from the runs: the run in which the k-th one (or before which the k-th zero) lies."""
        runs = self.runs().withColumn("_first", F.col("start") - F.col("z"))  # number of the run's first one
        asks = queries.where("k >= 0").select("qid", "k")
        if not ones:  # the last run with at most k zeros before it: all ones through it precede the zero
            got = latest(runs, asks, self.universe + 1, ["z", "zo"], value="z", at="k")
            found = F.col("k") + F.coalesce(F.col("zo") - F.col("z"), F.lit(0))
            got = got.select("qid", "k", F.when(found < self.universe, found).alias("pos"))
        else:
            got = latest(runs, asks, self.universe, ["_first", "start", "length"], value="_first", at="k")
            inside = F.col("k") - F.col("_first")
            got = got.select("qid", "k", F.when(inside < F.col("length"), F.col("start") + inside).alias("pos"))
        return queries.join(got, ["qid", "k"], "left")


@dataclass
class MultiSet:
    """``counts(pos, cnt)`` with distinct positions and positive counts."""

    counts: DataFrame
    universe: int

    @classmethod
    def build(cls, parts: DataFrame, universe: int) -> MultiSet:
        """From ``parts(pos, cnt)`` with repeats: counts add up, zero counts vanish."""
        return cls(parts.groupBy("pos").agg(F.sum("cnt").alias("cnt")).where("cnt > 0"), universe)

    def as_set(self, *, strict: bool = True) -> BitSet:
        """The positions as a set; strict: a count above one is an error."""
        ones = self.counts.select(F.when(F.col("cnt") == 1, F.col("pos")).otherwise(F.raise_error(F.lit("a position is held more than once"))).alias("pos")) if strict else self.counts.select("pos")
        return BitSet(ones, self.universe)

    def get(self, queries: DataFrame) -> DataFrame:
        return queries.join(self.counts.select(F.col("pos").alias("at"), "cnt"), "at", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))

    def rank1(self, queries: DataFrame) -> DataFrame:
        """Copies below ``at``."""
        return count_below(self.counts, queries, self.universe, weight="cnt", out="rank1")

    def unique_ranks(self, queries: DataFrame) -> DataFrame:
        """Positions held and not held below ``at``."""
        found = count_below(self.counts, queries, self.universe, out="unique_rank1")
        return found.withColumn("unique_rank0", F.least(F.col("at"), F.lit(self.universe)) - F.col("unique_rank1"))

    def select1(self, queries: DataFrame) -> DataFrame:
        """Position of the k-th copy; null if there are fewer."""
        total = self.counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("t")).first().t
        return kth_value(self.counts, queries, self.universe, weight="cnt", total=total).select("qid", "k", "pos")

    def stats(self) -> DataFrame:
        u = F.lit(self.universe).cast("long")
        return self.counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("num_ones"), F.count("*").alias("num_unique_ones")).select(u.alias("universe"), "num_ones", "num_unique_ones", (u - F.col("num_unique_ones")).alias("num_zeros"))
