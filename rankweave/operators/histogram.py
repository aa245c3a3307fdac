"""Log-linear histograms of non-negative integers and queries on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.h2 import bin_index, highest, lowest, num_bins
from rankweave.plans.ranking import count_below, kth_value


def histogram(values: DataFrame, a: int, b: int) -> DataFrame:
    """``(bin, cnt, cum)`` of ``values(v)``: one row per bin that occurs; cum counts through the bin."""
    bins = values.groupBy(bin_index(F.col("v"), a, b).alias("bin")).agg(F.count("*").alias("cnt"))
    # bins are logarithmic in the values: a few thousand rows at most
    return bins.withColumn("cum", F.sum("cnt").over(Window.orderBy("bin")))


def cumulative(hist: DataFrame, queries: DataFrame, a: int, b: int) -> DataFrame:
    """``(qid, cum, cdf)``: values in bins up to the one of ``v``."""
    asks = queries.select("qid", (bin_index(F.col("v"), a, b) + 1).alias("at"))
    got = count_below(hist, asks, num_bins(a, b, 63), value="bin", weight="cnt", out="cum")
    total = hist.agg(F.sum("cnt").alias("n"))  # one row
    return got.join(F.broadcast(total)).select("qid", "cum", F.coalesce(F.col("cum") / F.col("n"), F.lit(0.0)).alias("cdf"))


def quantiles(hist: DataFrame, queries: DataFrame, a: int, b: int) -> DataFrame:
    """``(qid, bin, low, high)``: the bin that holds the value of rank ``ceil(p * n)`` (at least 1)."""
    n = hist.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first().n
    want = F.greatest(F.ceil(F.col("p") * n), F.lit(1))
    got = kth_value(hist.select(F.col("bin").alias("pos"), "cnt"), queries.select("qid", "p", (want - 1).cast("long").alias("k")), num_bins(a, b, 63), weight="cnt", total=n, out="bin")
    return got.where("bin IS NOT NULL").select("qid", "bin", lowest(F.col("bin"), a, b).alias("low"), highest(F.col("bin"), a, b).alias("high"))
