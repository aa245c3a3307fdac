"""Models read from the driver's tables: only the columns a model needs reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence: user of each event."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("sym"))


def order_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence: customer of each order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("sym"))


def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence: size of each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("long").alias("sym"))


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence of points: x is the order's customer, y its price in thousands."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("x"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("y"))


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: x is the quantity of a line, y its supplier, id its order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_orderkey").alias("id"))


def error_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Bit set: positions of error events, and the universe."""
    events = table(spark, sf_dir, "events")
    return events.where("event_type = 'error'").select(F.col("event_id").alias("pos")), events.count()


def part_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Multiset: how many lines order each part, and the universe."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pos")).agg(F.count("*").alias("cnt"))
    return lines, table(spark, sf_dir, "part").count()


def customer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive integer lists: gaps between the sorted order keys of each customer (first key plus one)."""
    keys = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("k")), lambda i: F.when(i == 1, F.element_at("k", i) + 1).otherwise(F.element_at("k", i) - F.element_at("k", F.greatest(i - 1, F.lit(1)))))
    return keys.select("id", gaps.alias("values"))


def from_array(spark: SparkSession, symbols: list[int]) -> DataFrame:
    """A sequence from a list in memory."""
    return spark.createDataFrame([(k, int(s)) for k, s in enumerate(symbols)], "pos long, sym long")
