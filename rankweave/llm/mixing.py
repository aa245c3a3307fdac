"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source, documents stand in the order of size (ties by a hash digit of the id, then the id).
Every document expects ``target / source_size`` copies; the running sum of these expectations, moved by
one random offset, emits a document once per integer boundary that its own share crosses. Because the
order follows the size, the words taken from a source differ from its target by about the size of its
largest document. The running sum is kept in fixed point (2**-30), so it is exact and reruns agree.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.scratch import Scratch

ONE = 1 << 30
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, id_col: str, source_col: str, size_col: str, drop: tuple[str, ...]) -> DataFrame:
    """Each row of docs in one column, beside what decides on its copies; so no name of docs can clash."""
    source, id_ = F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in drop]).alias("row"),
        id_.alias("id"),
        F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("long").alias("_size"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("_sk"),
        F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, 2).alias("_digit"),
    )


def source_targets(totals: DataFrame, weights: tuple[int, ...], percent: int, cap: int) -> DataFrame:
    """``(_sk, source_size, target)`` from one row per source.

    Weights repeat over the sources in code-point order, null last. The sources share ``percent`` % of
    all words by weight; a share above ``cap`` times its source stops there and the rest is reshared.
    Sources are taken by how soon they reach their cap, so one running sum settles all of them. The
    windows here see one row per source, never documents.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("_place") % len(weights) + 1).cast("int")).cast("long")
    ranked = totals.withColumn("_place", F.row_number().over(Window.orderBy("_sk")) - 1).withColumn("_w", w)
    soonest = Window.orderBy(F.col("source_size") / F.col("_w"), "_sk")
    all_words = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumns(
        {
            "_room": 100 * cap * F.coalesce(F.sum("source_size").over(soonest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_weight": F.sum("_w").over(soonest.rowsBetween(0, Window.unboundedFollowing)),
            "_order": F.row_number().over(soonest),
            "_all": all_words * percent,
        }
    )
    level = (F.col("_all") - F.col("_room")).cast("double") / (F.col("_weight") * 100).cast("double")
    ranked = ranked.withColumn("_level", level).withColumn("_full", (F.col("source_size") * cap).cast("double") <= F.col("_level") * F.col("_w"))
    # the level of the first source that stays below its cap holds for all after it
    ranked = ranked.withColumn("_common", F.min(F.when(~F.col("_full"), F.struct("_order", "_level"))).over(Window.partitionBy()))
    capped = F.col("_common").isNull() | (F.col("_order") < F.col("_common._order"))
    target = F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(F.col("_common._level") * F.col("_w"))
    return ranked.select("_sk", "source_size", target.alias("target"))


def systematic_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
    out_cols: tuple[str, str, str] = ("source_size", "target", "copies"),
    weights: tuple[int, ...] = (5, 2, 1),
    percent: int = 150,
    cap: int = 2,
    seed: int = 20240501,
) -> DataFrame:
    """All rows and columns of docs, with the source's size, its target and the row's copies (0 to ``cap``).

    ``docs`` carries each document's size (see ``word_count``); a null size counts as 0. A null source is
    a source of its own, a null id sorts as the empty string, rows that repeat an id are separate
    documents. Empty documents are drawn like others, very long ones too. Input columns with the names of
    ``out_cols`` are replaced; others pass through, whatever their names. An empty table stays empty.

    Sources are few (thousands): the windows that share the words out see one row per source in one task.

    Skew: documents are dealt by (source, size, digit of a hash of the id), so neither a hot source nor
    many copies of one text meet in one task; the running sums over sources and sizes are formed on
    counts, first per size within the source and then per digit within the size.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    keyed = _keyed(docs, id_col, source_col, size_col, out_cols)
    cells = scratch.keep(keyed.groupBy("_sk", "_size", "_digit").agg(F.count("*").alias("n")), "cells")
    sizes = cells.groupBy("_sk", "_size").agg(F.sum("n").alias("n"))
    totals = sizes.groupBy("_sk").agg(F.sum(F.col("n") * F.col("_size")).cast("long").alias("source_size"))
    targets = source_targets(totals, weights, percent, cap)
    before = (Window.unboundedPreceding, -1)
    by_size = sizes.withColumn("_a", F.coalesce(F.sum("n").over(Window.partitionBy("_sk").orderBy("_size").rowsBetween(*before)), F.lit(0))).drop("n")
    starts = cells.withColumn("_b", F.coalesce(F.sum("n").over(Window.partitionBy("_sk", "_size").orderBy("_digit").rowsBetween(*before)), F.lit(0))).drop("n")
    starts = starts.join(by_size, ["_sk", "_size"]).join(targets, "_sk").select("_sk", "_size", "_digit", (F.col("_a") + F.col("_b")).alias("_start"), "source_size", "target")

    within = Window.partitionBy("_sk", "_size", "_digit").orderBy("id")
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * float(ONE) + 0.5)).otherwise(0).cast("long")
    offset = random.Random(seed).randrange(ONE)
    place = keyed.withColumn("_rn", (F.row_number().over(within) - 1).cast("long")).join(starts, ["_sk", "_size", "_digit"])
    at = ((F.col("_start") + F.col("_rn")) % ONE) * (share % ONE) % ONE + offset
    copies = (F.floor((at + share) / F.lit(ONE)) - F.floor(at / F.lit(ONE))).cast("int")
    names = [c for c in docs.columns if c not in out_cols]
    return place.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[c.alias(n) for c, n in zip((F.col("source_size"), F.col("target"), copies), out_cols, strict=True)])


MIX_SQL = """
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS digit FROM documents),
s AS (SELECT sk, sum(size)::BIGINT AS source_size FROM d GROUP BY sk),
p AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::INT] AS w FROM s),
q AS (SELECT *, 200 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
  sum(w) OVER (ORDER BY source_size / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight,
  row_number() OVER (ORDER BY source_size / w, sk) AS k, 150 * sum(source_size) OVER () AS everything FROM p),
l AS (SELECT *, (everything - room)::DOUBLE / (weight * 100)::DOUBLE AS level FROM q),
c AS (SELECT min(k) AS k FROM l WHERE NOT (source_size * 2)::DOUBLE <= level * w),
t AS (SELECT l.sk, l.source_size, CASE WHEN c.k IS NULL OR l.k < c.k THEN (l.source_size * 2)::DOUBLE
  ELSE (SELECT level FROM l AS m WHERE m.k = c.k) * l.w END AS target FROM l, c),
r AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.sk ORDER BY size, digit, doc_id) - 1 AS k,
  CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 1073741824.0 + 0.5)::BIGINT ELSE 0 END AS share FROM d JOIN t USING (sk)),
a AS (SELECT *, (k % 1073741824) * (share % 1073741824) % 1073741824 + {offset} AS pos FROM r)
SELECT doc_id, size, source_size, target, (size * ((pos + share) // 1073741824 - pos // 1073741824))::BIGINT AS taken FROM a
"""


def mix_sql(seed: int = 20240501) -> str:
    """The same mix as DuckDB SQL over ``documents``."""
    return MIX_SQL.replace("{offset}", str(random.Random(seed).randrange(ONE)))
