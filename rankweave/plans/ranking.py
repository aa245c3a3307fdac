"""Ranks, ordinals and lookups that never gather a whole table in one task.

All of them cut the axis of positions into blocks. Block sums are made by partial aggregation, so they are
all that is shuffled of the data; running sums over blocks give everything before a block, and only rows of
blocks that a query falls in are shuffled and ordered. Axes with very many blocks get blocks of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that a window over blocks sees at most.
MAX_BLOCKS = 1 << 16
#: log2 of the smallest and the largest block.
LEAST_BITS, MOST_BITS = 10, 16
#: Tables of queries or parameters up to this many rows are broadcast; larger ones are joined by other means.
BROADCAST_ROWS = 10_000


def block_bits(span: int) -> int:
    """log2 of the block size for positions below span: at most MAX_BLOCKS blocks, if blocks need not exceed 2**MOST_BITS."""
    return min(MOST_BITS, max(LEAST_BITS, int(max(span, 1)).bit_length() - MAX_BLOCKS.bit_length() + 1))


def is_small(df: DataFrame) -> bool:
    """Whether df has at most BROADCAST_ROWS rows; looks at no more."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small_table(df: DataFrame) -> DataFrame | None:
    """df of at most BROADCAST_ROWS narrow rows as a table of the driver, so that it is not worked out again;
    None if it is larger."""
    rows = df.limit(BROADCAST_ROWS + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= BROADCAST_ROWS else None


def checked_broadcast(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its size allows; otherwise the planner chooses."""
    return F.broadcast(df) if is_small(df) else df


def _before(keys: tuple[str, ...], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running_blocks(blocks: DataFrame, keys: tuple[str, ...], top: int, fold: Callable[[str], Column] = F.sum, tasks: int | None = None) -> DataFrame:
    """``blocks(keys, _b, _c, ...)``, one row per block up to number top, with ``_s``: ``_c`` of all earlier blocks
    of the key folded by sum or max (null where there is none). tasks: over so many tasks blocks of blocks are
    dealt; the session decides if it is not given."""
    if top < MAX_BLOCKS:
        return blocks.withColumn("_s", fold("_c").over(_before(keys, "_b")))
    step = MAX_BLOCKS.bit_length() - 1
    own = blocks.withColumn("_bb", F.shiftright("_b", step))
    upper = own.groupBy(*keys, "_bb").agg(fold("_c").alias("_c")).withColumnRenamed("_bb", "_b")
    upper = running_blocks(upper, keys, top >> step, fold).select(*keys, F.col("_b").alias("_bb"), F.col("_s").alias("_us"))
    dealt = own.repartition(tasks, *keys, "_bb") if tasks else own
    inside = dealt.withColumn("_s", fold("_c").over(_before((*keys, "_bb"), "_b"))).join(upper, [*keys, "_bb"])
    both = F.coalesce(F.col("_s") + F.col("_us"), "_s", "_us") if fold is F.sum else F.coalesce("_s", "_us")
    return inside.withColumn("_s", both).drop("_bb", "_us")


def block_table(values: DataFrame, span: int, *, keys: tuple[str, ...] = (), value: str = "pos", weight: str | None = None) -> DataFrame:
    """``(keys, _b, _c, _s)``: weight of each block of values below span, and weight before it."""
    w = F.count("*") if weight is None else F.sum(weight)
    bits = block_bits(span)
    sums = values.groupBy(*keys, F.shiftright(value, bits).alias("_b")).agg(w.cast("long").alias("_c"))
    return running_blocks(sums, keys, span >> bits).withColumn("_s", F.coalesce("_s", F.lit(0)))


def _merged(values: DataFrame, queries: DataFrame, span: int, keys: tuple[str, ...], value: str, at: str, carried: Column, none: Column, fold: Callable[[str], Column], data_first: bool) -> DataFrame:
    """queries as ``_q`` with ``_c``: what values of the same key and at smaller places carry, folded.

    Folded blocks give everything in earlier blocks; values and queries of one block meet in a task and are
    merged in order. data_first: values at the very place of the query count too.
    """
    bits = block_bits(span)
    place = F.greatest(F.least(F.col(at), F.lit(span)), F.lit(0)).cast("long")
    asks = queries.select(*keys, F.shiftright(place, bits).alias("_b"), place.alias("_v"), none.alias("_w"), F.lit(0).alias("_data"), F.struct(*queries.columns).alias("_q"))
    asked = asks.select(*keys, "_b").distinct()
    few = small_table(asked)
    data = values.select(*keys, F.shiftright(value, bits).alias("_b"), F.col(value).cast("long").alias("_v"), carried.alias("_w"), F.lit(1).alias("_data"))
    if few is not None:
        asked = few
        if keys:  # other keys matter to nobody
            data = data.join(F.broadcast(few.select(*keys).distinct()), list(keys), "left_semi")
    folded = data.select(*keys, "_b", "_w").unionByName(asked.withColumn("_w", none)).groupBy(*keys, "_b").agg(fold("_w").alias("_c"))
    starts = running_blocks(folded, keys, span >> bits, fold).select(*keys, "_b", "_s")
    near = data if few is None else data.join(F.broadcast(few), [*keys, "_b"], "left_semi")
    order = Window.partitionBy(*keys, "_b").orderBy("_v", F.col("_data").desc() if data_first else F.col("_data")).rowsBetween(Window.unboundedPreceding, 0)
    found = near.unionByName(asks, allowMissingColumns=True).withColumn("_i", fold("_w").over(order)).where("_data = 0").join(starts, [*keys, "_b"])
    both = F.coalesce("_s", F.lit(0)) + F.coalesce("_i", F.lit(0)) if fold is F.sum else F.coalesce("_i", "_s")
    return found.select("_q", both.alias("_c"))


def count_below(values: DataFrame, queries: DataFrame, span: int, *, keys: tuple[str, ...] = (), value: str = "pos", weight: str | None = None, at: str = "at", out: str = "below") -> DataFrame:
    """queries with the number (or weight) of values of the same key below ``at``; values lie in ``[0, span)``.

    Key columns must not be null.
    """
    carried = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    found = _merged(values, queries, span, keys, value, at, carried, F.lit(0).cast("long"), F.sum, False)
    return found.select("_q.*", F.col("_c").cast("long").alias(out))


def latest(values: DataFrame, queries: DataFrame, span: int, carry: list[str], *, keys: tuple[str, ...] = (), value: str = "pos", at: str = "at") -> DataFrame:
    """queries with the ``carry`` columns of the value of the same key that is the last one at or before ``at`` (by
    value, then carry); null if there is none. Values lie in ``[0, span)``; key columns must not be null."""
    carried = F.struct(F.col(value).cast("long").alias("_at"), *carry)
    kind = values.select(carried.alias("c")).schema["c"].dataType
    found = _merged(values, queries, span, keys, value, at, carried, F.lit(None).cast(kind), F.max, True)
    return found.select("_q.*", *[F.col(f"_c.{c}").alias(c) for c in carry])


def with_ordinal(rows: DataFrame, span: int, *, keys: tuple[str, ...] = (), pos: str = "pos", weight: str | None = None, out: str = "ordinal") -> DataFrame:
    """rows with the number (or weight) of rows of the same key at smaller positions (positions are unique per key)."""
    marked = rows.withColumn("_b", F.shiftright(pos, block_bits(span)))
    starts = block_table(rows, span, keys=keys, value=pos, weight=weight).select(*keys, "_b", "_s")
    w = _before((*keys, "_b"), pos)
    inside = F.count("*").over(w) if weight is None else F.coalesce(F.sum(weight).over(w), F.lit(0))
    return marked.withColumn("_r", inside).join(starts, [*keys, "_b"]).withColumn(out, (F.col("_s") + F.col("_r")).cast("long")).drop("_b", "_r", "_s")


def kth_value(values: DataFrame, asks: DataFrame, span: int, *, weight: str | None = None, total: int, out: str = "pos") -> DataFrame:
    """``asks(qid, k, ...)`` with the value that holds the k-th unit (0-based) of all weights, null if there are fewer.

    total: the sum of all weights (or more). Blocks are counted first, and only blocks that hold an answer are
    ordered.
    """
    bits = block_bits(span)
    # the units of a block are an interval; laid on cells of the usual size of a block, it meets its questions by equality
    cell = max(0, (max(total, 1) // ((span >> bits) + 1)).bit_length() - 1)
    laid = F.explode(F.sequence(F.shiftright("_s", cell), F.shiftright(F.col("_s") + F.col("_c") - 1, cell)))
    table = block_table(values, span, weight=weight).where("_c > 0").withColumn("_cell", laid)
    held = asks.where("k >= 0").select("qid", "k", F.shiftright(F.col("k").cast("long"), cell).alias("_cell")).join(table, "_cell")
    inside = held.where("_s <= k AND k < _s + _c").select("qid", "k", "_b", (F.col("k") - F.col("_s")).alias("_v"))
    asked = inside.select("_b").distinct()
    if span >> bits < BROADCAST_ROWS or is_small(asks):  # no more blocks than that
        asked = F.broadcast(asked)
    near = values.withColumn("_b", F.shiftright("pos", bits)).join(asked, "_b", "left_semi")
    before = _before(("_b",), "pos")
    first = F.count("*").over(before) if weight is None else F.coalesce(F.sum(weight).over(before), F.lit(0))
    data = near.select("_b", first.alias("_v"), F.lit(0).alias("_ask"), F.col("pos").alias("_p"))
    rows = data.unionByName(inside.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    # the last value that begins at or before the unit asked for
    last = F.last("_p", ignorenulls=True).over(Window.partitionBy("_b").orderBy("_v", "_ask").rowsBetween(Window.unboundedPreceding, 0))
    got = rows.withColumn("_held", last).where("_ask = 1").select("qid", "k", F.col("_held").alias(out))
    return asks.join(got, ["qid", "k"], "left")


def kth_in_order(matches: DataFrame, asks: DataFrame, span: int, *, last: bool = False, out: str = "found") -> DataFrame:
    """``(qid, found)`` for every row of ``asks(qid, k)``: the position of its k-th match, null if it has fewer.

    ``matches(qid, pos)`` may be huge: blocks are counted first, and only the block that holds the k-th
    match is ordered.
    """
    if last:  # from the right: positions turned round
        turned = matches.withColumn("pos", F.lit(span - 1) - F.col("pos"))
        return kth_in_order(turned, asks, span, out="_turned").select("qid", (F.lit(span - 1) - F.col("_turned")).alias(out))
    table = block_table(matches, span, keys=("qid",))
    target = table.join(asks.select("qid", "k"), "qid").where("_s <= k AND k < _s + _c").select("qid", "_b", (F.col("k") - F.col("_s") + 1).alias("_want"))
    inside = F.row_number().over(Window.partitionBy("qid").orderBy("pos"))
    marked = matches.withColumn("_b", F.shiftright("pos", block_bits(span)))
    got = marked.join(target, ["qid", "_b"]).withColumn("_r", inside).where("_r = _want").select("qid", F.col("pos").alias(out))
    return asks.select("qid").join(got, "qid", "left")


def in_ranges(seq: DataFrame, queries: DataFrame, *, also: Column | None = None, bits: int = 12) -> DataFrame:
    """seq x queries where ``lo <= pos < hi`` and ``also`` hold.

    A small query table travels to the scan, whose rows then meet a partial aggregation; a large one is
    spread over position blocks and joined on the block number.
    """
    inside = (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))
    if also is not None:
        inside = inside & also
    if is_small(queries):
        return seq.join(F.broadcast(queries), inside)
    spread = queries.where("hi > lo").withColumn("_b", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright(F.col("hi") - 1, bits))))
    return seq.withColumn("_b", F.shiftright("pos", bits)).join(spread, "_b").where(inside).drop("_b")
