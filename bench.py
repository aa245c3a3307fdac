"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Batch queries ask thousands of questions in one job; each is timed to the end of a write to the
no-operation sink, after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rankweave.operators.bits import BitSet, MultiSet  # noqa: E402
from rankweave.operators.sequence import Sequence  # noqa: E402
from rankweave.plans.index import SequenceIndex  # noqa: E402
from rankweave.sources import tables  # noqa: E402
from rankweave.sources.scratch import scratch_folder  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def spread(spark: SparkSession, n: int, span: int, *names: str):
    """n query rows whose columns are pseudo-random numbers below span."""
    return spark.range(n).select(F.col("id").alias("qid"), *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(max(span, 1))).alias(c) for k, c in enumerate(names)])


def ranges(spark: SparkSession, n: int, span: int, symbols: int):
    q = spread(spark, n, span, "a", "b")
    lo, hi = F.least("a", "b"), F.greatest("a", "b") + 1
    return q.select("qid", lo.alias("lo"), hi.alias("hi"), F.pmod(F.xxhash64("qid"), F.lit(symbols)).alias("symbol"), F.floor((hi - lo) / 2).alias("k"), F.lit(0).alias("ignore_bits"))


def headline(spark: SparkSession) -> dict:
    """Name -> a function that returns the DataFrame to be timed."""
    bits = BitSet(*tables.error_events(spark, SF_DIR))
    multi = MultiSet(*tables.part_lines(spark, SF_DIR))
    events, orders = Sequence.of(tables.event_users(spark, SF_DIR)), Sequence.of(tables.order_customers(spark, SF_DIR))
    few = ranges(spark, 100, events.length, events.max_symbol + 1)
    million = BitSet(spark.range(1_000_000).where(F.pmod(F.xxhash64("id"), F.lit(1000)) == 0).select(F.col("id").alias("pos")), 1_000_000)
    dense = BitSet(spark.range(1_000_000).where(F.pmod(F.xxhash64("id"), F.lit(10)) < 7).select(F.col("id").alias("pos")), 1_000_000)
    index = SequenceIndex.build(events, scratch_folder(spark, "bench-index"))
    return {
        "rank1_50k_sparse_0.1pct": lambda: million.rank1(spread(spark, 50_000, 1_000_000, "at")),
        "rank1_50k_dense_70pct": lambda: dense.rank1(spread(spark, 50_000, 1_000_000, "at")),
        "rank1_100k_events": lambda: bits.rank1(spread(spark, 100_000, bits.universe, "at")),
        "select1_100k_events": lambda: bits.select1(spread(spark, 100_000, bits.universe // 5, "k")),
        "multiset_rank1_100k": lambda: multi.rank1(spread(spark, 100_000, multi.universe, "at")),
        "count_100k_events": lambda: events.count(ranges(spark, 100_000, events.length, events.max_symbol + 1)),
        "count_100k_orders": lambda: orders.count(ranges(spark, 100_000, orders.length, orders.max_symbol + 1)),
        "get_100k_events": lambda: events.get(spread(spark, 100_000, events.length, "at")),
        "quantile_100_ranges": lambda: events.quantile(few),
        "majority_100_ranges": lambda: events.majority(few.withColumn("parts", F.lit(1000))),
        "select_100_ranges": lambda: events.select(few.withColumn("k", F.lit(0).cast("long"))),
        "quantile_5k_ranges_indexed": lambda: index.quantile(ranges(spark, 5_000, events.length, events.max_symbol + 1)),
        "level_words": lambda: events.level_words(),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    jobs = headline(spark)
    next(iter(jobs.values()))().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR).removeprefix("sf")}))


if __name__ == "__main__":
    main()
