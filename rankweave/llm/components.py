"""Connected components of an edge table by alternating hub contraction, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rankweave.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges(a, b)``; component is the smallest id reachable.

    Each round links all larger neighbours of a vertex to its smallest neighbour and then all smaller
    ones likewise (large-star, small-star); the graph becomes a forest of stars after O(log n) rounds.
    Both steps are an aggregate and a join, so a vertex with very many neighbours is only ever handled
    as rows (partial aggregation before the shuffle, skew-split join after it).
    Rows with a null end are ignored; an empty table gives an empty result.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.keep(now, f"{label}-0")
    before = None
    for k in range(1, max_rounds + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.expr("if(v = m, array(struct(u, m AS v)), array(struct(u, m AS v), struct(v AS u, m AS v)))")).alias("e")).select("e.u", "e.v").distinct()
        state = Observation()
        now = scratch.keep(small.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.expr("hash(u, v)").cast("long")).alias("sum"), F.bit_xor(F.xxhash64("u", "v")).alias("xor")), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
        after = state.get
        if after == before or not after.get("n"):
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
