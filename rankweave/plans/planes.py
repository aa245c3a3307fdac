"""Bit planes of a sequence of codes, packed into words, for any length and alphabet.

A level of the planes is ordered by the reversed higher bits, then position, so it is the level above dealt
stably by one bit, and a level j lower is dealt by j bits. Levels are made in passes of at most DIGIT_BITS: the
places of the pass's first level are cut into chunks, counts of digits give where each chunk's share of each
digit begins on every level of the pass, and a task deals its chunk level by level and hands on whole words.
Each pass shuffles a row per symbol once, by chunks of equal size whatever the symbols are. How many tasks deal
chunks or take words follows from the length, not from the session's partitions or cores, so that a task's
share does not grow with the sequence.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.bitmath import reverse_low_bits
from rankweave.sources.scratch import scratch_folder

#: log2 of the places in a chunk; there are as many tasks as chunks.
CHUNK_BITS = 18
#: log2 of the words that a task takes on average where words are merged, ranked or written.
WORD_BITS = 18
#: Levels of one pass at most.
DIGIT_BITS = 10

#: words of a level (block, word, its ones), or at level -1 rows for the next pass (place, code, len)
OUT = "level int, a long, b long, c long"


def word_tasks(levels: int, length: int) -> int:
    """Tasks for the words of so many levels."""
    return (levels * (length >> 5) >> WORD_BITS) + 1


def packed_planes(coded: DataFrame, top: int, length: int) -> DataFrame:
    """``(level, block, word, ones)`` of ``coded(pos, code, len)``, top level first: codes have ``top`` bits, of which
    the first ``len`` count; a level holds the rows whose codes reach it. Words have 32 bits; there are ``length``
    positions."""
    spark = coded.sparkSession
    folder = scratch_folder(spark, "planes")
    passes = max(-(-top // DIGIT_BITS), 1)
    rows = coded.where("len > 0").select(F.col("pos").alias("idx"), F.col("code").cast("long").alias("code"), F.col("len").cast("int").alias("len")).dropna()
    made = []
    for k in range(passes):
        first, end = top * k // passes, top * (k + 1) // passes
        _pass(rows, top, first, end - first, (length >> CHUNK_BITS) + 1).write.parquet(f"{folder}/{k}")
        made.append(spark.read.schema(OUT).parquet(f"{folder}/{k}"))
        rows = made[-1].where("level = -1").select(F.col("a").alias("idx"), F.col("b").alias("code"), F.col("c").cast("int").alias("len"))
    words = made[0]
    for more in made[1:]:
        words = words.unionAll(more)
    # a word at the border of two shares comes in parts
    parts = words.where("level >= 0").select(F.col("level").cast("long").alias("level"), F.col("a").alias("block"), "b", "c").repartition(word_tasks(top, length), "level", "block")
    return parts.groupBy("level", "block").agg(F.sum("b").alias("word"), F.sum("c").alias("ones"))


def _pass(rows: DataFrame, top: int, first: int, width: int, tasks: int) -> DataFrame:
    """Words of levels first to first + width - 1, and the rows that go on, from rows(idx, code, len) placed on level first."""
    chunk = F.shiftright("idx", CHUNK_BITS).alias("chunk")
    digit = reverse_low_bits(F.shiftright("code", top - first - width), max(width, 1)) if width else F.lit(0).cast("long")
    reach = F.least(F.col("len") - first, F.lit(width + 1))  # levels from first on, as far as they matter here
    counts = rows.groupBy(chunk, digit.alias("digit"), reach.alias("reach")).agg(F.count("*").alias("c"))
    each = counts.select("chunk", "digit", "c", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("j"))
    value = F.col("digit").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j")) - 1)
    shares = each.groupBy("chunk", "j", value.alias("v")).agg(F.sum("c").alias("c"))
    before = lambda keys, order: F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = shares.groupBy("j", "v").agg(F.sum("c").alias("c")).select("j", "v", before(["j"], "v").alias("_v"))
    bases = shares.withColumn("_c", before(["j", "v"], "chunk")).join(values, ["j", "v"]).select("chunk", "j", "v", (F.col("_v") + F.col("_c")).alias("base"))
    return rows.select(chunk, "idx", "code", "len").repartition(tasks, "chunk").groupBy("chunk").cogroup(bases.groupBy("chunk")).applyInArrow(_dealer(top, first, width), OUT)


def _dealer(top: int, first: int, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def deal(rows: pa.Table, bases: pa.Table) -> pa.Table:
        order = np.argsort(rows["idx"].to_numpy(), kind="stable")
        code, reach = rows["code"].to_numpy()[order], rows["len"].to_numpy()[order].astype(np.int64) - first
        level_of, value_of, base_of = (bases[c].to_numpy() for c in ("j", "v", "base"))
        out: list[tuple[np.ndarray, ...]] = []

        def places(j: int, value: np.ndarray) -> np.ndarray:
            """Places on level first + j of rows in order of their values."""
            base, mine = np.zeros(1 << j, np.int64), level_of == j
            base[value_of[mine]] = base_of[mine]
            size = np.bincount(value, minlength=1 << j)
            return np.arange(len(value)) + (base - (np.cumsum(size) - size))[value]

        value = np.zeros(len(code), np.int64)
        for j in range(width):
            live = reach > j
            if not live.all():
                code, reach, value = code[live], reach[live], value[live]
            if not len(code):
                break
            at, bit = places(j, value), code >> (top - 1 - first - j) & 1
            block = at >> 5
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            out.append((np.full(len(starts), first + j), block[starts], np.add.reduceat(bit << (at & 31), starts), np.add.reduceat(bit, starts)))
            dealt = np.argsort(bit.astype(np.int8), kind="stable")
            code, reach, value = code[dealt], reach[dealt], (value | bit << j)[dealt]
        live = reach > width
        if live.any():
            code, reach, value = code[live], reach[live], value[live]
            out.append((np.full(len(code), -1), places(width, value), code, reach + first))
        level, a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        return pa.table({"level": level.astype(np.int32), "a": a, "b": b, "c": c})

    return deal
