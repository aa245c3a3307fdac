"""Range queries over a positional sequence of symbols ``seq(pos, sym)``.

Queries are tables ``(qid, lo, hi, ...)`` over half-open position ranges. Most answers derive from one
histogram ``(qid, sym, cnt)``: the scan meets the queries and is partially aggregated at once, so what is
shuffled are symbol counts, not positions. Where a position is asked for, blocks are counted first and
only one block is ordered. ``ignore_bits`` drops that many low bits of data and query symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.bitmath import num_levels, reverse_low_bits
from rankweave.functions.zorder import decode2, decode3, encode2
from rankweave.plans.boxes import in_boxes
from rankweave.plans.planes import packed_planes, word_tasks
from rankweave.plans.ranking import checked_broadcast, count_below, in_ranges, kth_in_order, latest, running_blocks, with_ordinal


def _cut(symbol: Column, bits: Column) -> Column:
    return F.call_function("shiftright", symbol, bits.cast("int"))


def _cleared(symbol: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", _cut(symbol, bits), bits.cast("int"))


@dataclass
class Sequence:
    """``seq(pos, sym)`` with dense positions from 0, its length and largest symbol."""

    seq: DataFrame
    length: int
    max_symbol: int

    @classmethod
    def of(cls, seq: DataFrame) -> Sequence:
        n = seq.agg(F.count("*").alias("n"), F.coalesce(F.max("sym"), F.lit(0)).alias("m")).first()
        return cls(seq, n.n, n.m)

    @property
    def levels(self) -> int:
        return num_levels(self.max_symbol)

    def _rev(self, symbol: Column) -> Column:
        return reverse_low_bits(symbol, self.levels)

    def _histogram(self, queries: DataFrame, also: Column | None = None) -> DataFrame:
        return in_ranges(self.seq, queries.select("qid", "lo", "hi"), also=also).groupBy("qid", "sym").agg(F.count("*").alias("cnt"))

    @property
    def _whole(self) -> Column:
        """Whether the symbol holds the row's coordinates in full: sequences of points may have a column ``whole``."""
        return F.col("whole") if "whole" in self.seq.columns else F.lit(True)

    # -- single values ------------------------------------------------------------------------------

    def get(self, queries: DataFrame) -> DataFrame:
        """Symbol at ``at``; null outside the sequence."""
        return queries.join(self.seq.select(F.col("pos").alias("at"), "sym"), "at", "left")

    def stats(self) -> DataFrame:
        m = F.coalesce(F.max("sym"), F.lit(0))
        return self.seq.agg(F.count("*").alias("len"), m.alias("max_symbol")).select("len", "max_symbol", F.length(F.bin("max_symbol")).cast("long").alias("num_levels"))

    def count(self, queries: DataFrame) -> DataFrame:
        """Occurrences of ``symbol``: its rank at ``hi`` less its rank at ``lo``, looked up per symbol.

        No scan meets all queries: data and queries are dealt by (symbol, block), so very many queries cost
        two lookups each.
        """
        q = queries.where("hi > lo")
        ends = q.select("qid", F.col("symbol").alias("sym"), F.explode(F.array(F.struct(F.col("hi").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("lo").alias("at"), F.lit(-1).alias("sign")))).alias("e"))
        ends = ends.select("qid", "sym", F.col("e.at").alias("at"), F.col("e.sign").alias("sign"))
        got = count_below(self.seq, ends, self.length, keys=("sym",)).groupBy("qid").agg(F.sum(F.col("below") * F.col("sign")).alias("cnt"))
        return queries.join(got, "qid", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))

    def preceding_count(self, queries: DataFrame) -> DataFrame:
        """Symbols in the range that are below ``symbol``."""
        rows = in_ranges(self.seq, queries, also=F.col("sym") < F.col("symbol")).groupBy("qid").agg(F.count("*").alias("cnt"))
        return queries.join(rows, "qid", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))

    def quantile(self, queries: DataFrame) -> DataFrame:
        """``(qid, k, symbol, cnt)``: the k-th smallest symbol (0-based) and its count in the range.

        Several k of one range share its histogram: ``queries`` may repeat a qid with different k. No row
        where the range has k symbols or fewer.
        """
        hist = self._histogram(queries.select("qid", "lo", "hi").distinct())
        before = Window.partitionBy("qid").orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
        upto = hist.withColumn("_s", F.coalesce(F.sum("cnt").over(before), F.lit(0)))
        return upto.join(queries.select("qid", "k"), "qid").where("_s <= k AND k < _s + cnt").select("qid", "k", F.col("sym").alias("symbol"), "cnt")

    def select(self, queries: DataFrame, *, last: bool = False) -> DataFrame:
        """``(qid, pos)``: position of the k-th occurrence of ``symbol`` in the range, from the left or the right."""
        b = F.col("ignore_bits")
        rows = in_ranges(self.seq, queries, also=_cut(F.col("sym"), b) == _cut(F.col("symbol"), b)).select("qid", "pos")
        return kth_in_order(rows, queries, self.length, last=last, out="pos")

    def first_at_most(self, queries: DataFrame) -> DataFrame:
        """First position in the range whose symbol is at most ``symbol``; null if there is none."""
        rows = in_ranges(self.seq, queries, also=F.col("sym") <= F.col("symbol")).groupBy("qid").agg(F.min("pos").alias("pos"))
        return queries.select("qid").join(rows, "qid", "left")

    # -- frequent symbols ---------------------------------------------------------------------------

    def majority(self, queries: DataFrame) -> DataFrame:
        """``(qid, symbol, cnt)``: symbols that make up more than a ``parts``-th of the range."""
        hist = self._histogram(queries).join(queries.select("qid", "lo", "hi", "parts"), "qid")
        return hist.where(F.col("cnt") * F.col("parts") > F.least("hi", F.lit(self.length)) - F.col("lo")).select("qid", F.col("sym").alias("symbol"), "cnt")

    def simple_majority(self, queries: DataFrame) -> DataFrame:
        """``(qid, symbol)``: the symbol of more than half of the range, or null."""
        got = self.majority(queries.withColumn("parts", F.lit(2)))
        return queries.select("qid").join(got.select("qid", "symbol"), "qid", "left")

    # -- the order of the lowest level ----------------------------------------------------------------
    # There symbols stand in the order of their reversed bits, equal ones by position.

    @property
    def _span(self) -> int:
        """Above every reversed symbol."""
        return 1 << self.levels

    def _nodes(self, bits: DataFrame) -> DataFrame:
        """``(ignore_bits, node, c, r)``: occurrences of each symbol with the low bits cleared, and its place in the
        order; bits has at most one row for each number of bits that a symbol can have."""
        totals = self.seq.groupBy("sym").agg(F.count("*").alias("c")).join(F.broadcast(bits))
        node = _cleared(F.col("sym"), F.col("ignore_bits"))
        return totals.groupBy("ignore_bits", node.alias("node")).agg(F.sum("c").alias("c")).withColumn("r", self._rev(F.col("node")))

    def _bits_of(self, queries: DataFrame) -> DataFrame:
        return queries.where(F.col("ignore_bits").between(0, 63)).select("ignore_bits").distinct()

    def _rows_of(self, bits: DataFrame) -> DataFrame:
        """``(pos, ignore_bits, node)`` of the sequence for each number of ignored bits."""
        return self.seq.join(F.broadcast(bits)).select("pos", "ignore_bits", _cleared(F.col("sym"), F.col("ignore_bits")).alias("node"))

    def _ranks(self, q: DataFrame, at: str, out: str) -> DataFrame:
        """q with the occurrences of ``node`` before ``at``, looked up per node and block."""
        return count_below(self._rows_of(self._bits_of(q)), q, self.length, keys=("ignore_bits", "node"), at=at, out=out)

    def counts(self, queries: DataFrame) -> DataFrame:
        """``(qid, symbol, start, end)`` for every symbol of the range: its interval on the lowest level.

        ``queries`` has ``ignore_bits`` and an inclusive extent ``s_lo, s_hi``; with ignored bits a symbol
        stands for all that share its high bits, and is kept whole if any of them lies in the extent.
        """
        b = F.col("ignore_bits")
        node = _cleared(F.col("sym"), b)
        q = queries.select("qid", "lo", "hi", "ignore_bits", "s_lo", "s_hi")
        meets = (node <= F.col("s_hi")) & (node + F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int")) > F.col("s_lo"))
        return self._intervals(q, meets)

    def _intervals(self, q: DataFrame, meets: Column, gaps: bool = False) -> DataFrame:
        """Intervals of the nodes of each range; gaps: rows of one node may meet or not, so the interval ends with the last that does."""
        node = _cleared(F.col("sym"), F.col("ignore_bits"))
        seen = in_ranges(self.seq, q, also=meets).groupBy("qid", "lo", "ignore_bits", node.alias("node"))
        bases = with_ordinal(self._nodes(self._bits_of(q)), self._span, keys=("ignore_bits",), pos="r", weight="c", out="base").select("ignore_bits", "node", "base")
        if gaps:
            ends = seen.agg(F.array(F.min("pos"), F.max("pos")).alias("_e")).select("qid", "ignore_bits", "node", F.explode("_e").alias("at"))
            ranks = self._ranks(ends, "at", "rank").groupBy("qid", "ignore_bits", "node").agg(F.min("rank").alias("rank"), (F.max("rank") - F.min("rank") + 1).alias("cnt"))
        else:
            ranks = self._ranks(seen.agg(F.count("*").alias("cnt")), "lo", "rank")
        placed = ranks.join(bases, ["ignore_bits", "node"])
        start = F.col("base") + F.col("rank")
        return placed.select("qid", F.col("node").alias("symbol"), start.alias("start"), (start + F.col("cnt")).alias("end"))

    def counts_union(self, queries: DataFrame) -> DataFrame:
        """``(symbol, start, end)``: intervals of ascending disjoint ranges, merged where they touch."""
        q = queries.select("qid", "lo", "hi", "ignore_bits")
        rows = self._intervals(q, F.lit(True)).join(q.select("qid"), "qid")
        w = Window.partitionBy("symbol").orderBy("start", "end")
        fresh = F.coalesce(F.lag("end").over(w) != F.col("start"), F.lit(True))
        grouped = rows.withColumn("g", fresh.cast("int")).withColumn("g", F.sum("g").over(w))
        return grouped.groupBy("symbol", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")

    def locate(self, queries: DataFrame) -> DataFrame:
        """``(qid, preceding_count, start, end)`` of ``symbol`` in the range."""
        b = F.col("ignore_bits")
        q = queries.select("qid", "lo", "hi", "symbol", "ignore_bits").withColumn("node", _cleared(F.col("symbol"), b))
        less = in_ranges(self.seq, q, also=_cut(F.col("sym"), b) < _cut(F.col("symbol"), b)).groupBy("qid").agg(F.count("*").alias("preceding_count"))
        # the base of a symbol that does not occur is where it would stand
        own = q.select("qid", "ignore_bits", "node", self._rev(F.col("node")).alias("r"))
        base = count_below(self._nodes(self._bits_of(q)), own, self._span, keys=("ignore_bits",), value="r", weight="c", at="r", out="base").select("qid", "base")
        ends = q.select("qid", "ignore_bits", "node", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("lo").alias("at")), F.struct(F.lit(1).alias("e"), F.col("hi").alias("at")))).alias("x")).select("qid", "ignore_bits", "node", "x.e", "x.at")
        ranks = self._ranks(ends, "at", "rank").groupBy("qid").agg(F.max(F.when(F.col("e") == 0, F.col("rank"))).alias("lo_rank"), F.max("rank").alias("hi_rank"))
        rows = q.select("qid").join(less, "qid", "left").join(base, "qid").join(ranks, "qid")
        start = F.col("base") + F.col("lo_rank")
        return rows.select("qid", F.coalesce("preceding_count", F.lit(0)).alias("preceding_count"), start.alias("start"), (F.col("base") + F.col("hi_rank")).alias("end"))

    def locate_batch(self, ranges: DataFrame, symbols: DataFrame) -> DataFrame:
        """``(key, symbol, preceding_count, start, end)`` for every symbol in every range.

        ``ranges(range_idx, lo, hi)``, ``symbols(sym_idx, symbol, ignore_bits)``; key numbers the pairs, all
        ranges of the first symbol first. Both are parameter lists: their product is the question asked.
        """
        n = ranges.count()
        pairs = symbols.join(checked_broadcast(ranges)).withColumn("qid", F.col("sym_idx") * n + F.col("range_idx"))
        return self.locate(pairs).join(pairs.select("qid", "symbol"), "qid").select(F.col("qid").alias("key"), "symbol", "preceding_count", "start", "end")

    def select_upwards(self, queries: DataFrame) -> DataFrame:
        """``(qid, pos)``: sequence position of lowest-level index ``at`` under ``ignore_bits``."""
        nodes = with_ordinal(self._nodes(self._bits_of(queries)), self._span, keys=("ignore_bits",), pos="r", weight="c", out="base")
        asks = queries.where((F.col("at") >= 0) & (F.col("at") < self.length)).select("qid", "ignore_bits", F.col("at").alias("k"))
        # the node that holds index k is the last whose base is not above it
        held = latest(nodes, asks, max(self.length, 1), ["node", "base"], keys=("ignore_bits",), value="base", at="k").where("node IS NOT NULL")
        own = held.select("qid", "ignore_bits", F.col("node").alias("symbol"), (F.col("k") - F.col("base")).alias("k"), F.lit(0).cast("long").alias("lo"), F.lit(self.length).cast("long").alias("hi"))
        return queries.select("qid").join(self.select(own), "qid", "left")

    def _coded(self) -> DataFrame:
        return self.seq.select("pos", F.col("sym").alias("code"), F.lit(self.levels).alias("len"))

    def level_bits(self) -> DataFrame:
        """``(level, idx, bit)``: every level's bit plane, top level first."""
        words = packed_planes(self._coded(), self.levels, self.length).select("level", (F.col("block") * 32).alias("_at"), "word", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("_i"))
        bit = F.call_function("shiftright", F.col("word"), F.col("_i")).bitwiseAND(F.lit(1))
        return words.select("level", (F.col("_at") + F.col("_i")).alias("idx"), bit.alias("bit")).where(F.col("idx") < self.length)

    def level_words(self) -> DataFrame:
        """``(level, block, word, rank1)``: the bit planes in words of 32 bits, with the ones before each word
        in its level - the layout that a persisted index keeps (one row per 32 bits)."""
        return coded_words(self._coded(), self.levels, self.length)

    # -- symbol ranges and boxes ----------------------------------------------------------------------

    def count_batch(self, ranges: DataFrame, buckets: DataFrame) -> DataFrame:
        """``(qid, bucket, cnt)``: symbols of each range in each inclusive symbol range (zeros included)."""
        hist = self._histogram(ranges)
        # both ends of a bucket are ranks among the symbols of the range
        ends = F.explode(F.array(F.struct(F.col("s_lo").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("s_hi") + 1).alias("at"), F.lit(1).alias("sign")))).alias("e")
        asks = ranges.select("qid").join(checked_broadcast(buckets.select("bucket", "s_lo", "s_hi"))).select("qid", "bucket", ends).select("qid", "bucket", "e.at", "e.sign")
        got = count_below(hist, asks, self.max_symbol + 1, keys=("qid",), value="sym", weight="cnt").groupBy("qid", "bucket").agg(F.sum(F.col("below") * F.col("sign")).alias("cnt"))
        return got.select("qid", "bucket", F.greatest("cnt", F.lit(0)).alias("cnt"))

    def box_counts(self, ranges: DataFrame, boxes: DataFrame, dims: int) -> DataFrame:
        """``(qid, box, cnt)``: points (Morton symbols) of each range in each box, given by corner codes. Points
        whose codes lost high bits lie in no box."""
        decode = decode2 if dims == 2 else decode3
        names = "xyz"[:dims]
        flat = boxes.select("box", *[c.alias(f"{n}0") for n, c in zip(names, decode(F.col("low")), strict=True)], *[c.alias(f"{n}1") for n, c in zip(names, decode(F.col("high")), strict=True)])
        points = self._histogram(ranges, self._whole).select("qid", "cnt", *[c.alias(n) for n, c in zip(names, decode(F.col("sym")), strict=True)])
        got = in_boxes(points, flat, names).groupBy("qid", "box").agg(F.sum("cnt").alias("cnt"))
        return ranges.select("qid").join(checked_broadcast(boxes.select("box"))).join(got, ["qid", "box"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))

    def box_intervals(self, queries: DataFrame) -> DataFrame:
        """``counts`` with a two-dimensional box (corner codes ``low, high``) as the extent, whole symbols only.

        A symbol may also stand for points whose codes lost high bits: they keep their places on the lowest level
        but lie in no box, so an interval goes from the first to the last point that the box holds.
        """
        (x, y), (x0, y0), (x1, y1) = decode2(F.col("sym")), decode2(F.col("low")), decode2(F.col("high"))
        q = queries.select("qid", "lo", "hi", F.lit(0).alias("ignore_bits"), "low", "high")
        return self._intervals(q, x.between(x0, x1) & y.between(y0, y1) & self._whole, gaps="whole" in self.seq.columns)


def coded_words(coded: DataFrame, top: int, length: int) -> DataFrame:
    """``(level, block, word, rank1)`` of ``coded(pos, code, len)``: codes have ``top`` bits, of which the first ``len``
    count; a level holds the rows whose codes reach it, ordered by the reversed higher bits, then position."""
    words = packed_planes(coded, top, length).select("level", F.col("block").alias("_b"), "word", F.col("ones").alias("_c"))
    return _ranked_words(words, top, length)


def plane_words(bits: DataFrame, levels: int, length: int) -> DataFrame:
    """``(level, block, word, rank1)`` of ``bits(level, idx, bit)``: words of 32 bits and the ones before each."""
    bit = F.call_function("shiftleft", F.col("bit"), F.col("idx").bitwiseAND(F.lit(31)).cast("int"))
    words = bits.groupBy("level", F.shiftright("idx", 5).alias("_b")).agg(F.sum(bit).alias("word"), F.sum("bit").alias("_c"))
    return _ranked_words(words, levels, length)


def _ranked_words(words: DataFrame, levels: int, length: int) -> DataFrame:
    return running_blocks(words, ("level",), length >> 5, tasks=word_tasks(levels, length)).select("level", F.col("_b").alias("block"), "word", F.coalesce("_s", F.lit(0)).alias("rank1"))


def counts_arrays(counts: DataFrame) -> DataFrame:
    """``(qid, symbols, starts, ends)``: the intervals of each query as parallel arrays, by start."""
    rows = counts.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "symbol"))).alias("r"))
    return rows.select("qid", F.col("r.symbol").alias("symbols"), F.col("r.start").alias("starts"), F.col("r.end").alias("ends"))


def morton_sequence(points: DataFrame) -> DataFrame:
    """``(pos, sym, whole)`` with the two-dimensional codes of ``points(pos, x, y)`` as symbols; not whole are points
    with a coordinate of more than 16 bits, whose codes lack the high ones."""
    fits = F.col("x").between(0, 0xFFFF) & F.col("y").between(0, 0xFFFF)
    return points.select("pos", encode2(F.col("x"), F.col("y")).alias("sym"), fits.alias("whole"))
