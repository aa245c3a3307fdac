"""The library's queries as SQL functions of a session, for sets and sequences that are registered under a name.

All are SQL functions over temporary views, inlined by the planner. Functions named ``try_...`` give null where
there is no answer, the others raise an error.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from rankweave.operators.bits import BitSet, MultiSet
from rankweave.operators.sequence import Sequence


def _define(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def register_set(spark: SparkSession, name: str, bits: BitSet) -> None:
    """``<name>_rank1(i)``, ``_rank0(i)``, ``_get(i)``, ``_select1(k)``, ``_select0(k)`` and their ``try_`` forms,
    ``_universe_size()``, ``_num_ones()``, ``_num_zeros()``; the ones are the view ``<name>``."""
    bits.ones.createOrReplaceTempView(name)
    n = f"CAST({bits.universe} AS BIGINT)"
    zeros = f"(SELECT id AS pos FROM range({bits.universe}) LEFT ANTI JOIN {name} ON id = pos)"
    _define(spark, f"{name}_universe_size", "", "BIGINT", n)
    _define(spark, f"{name}_num_ones", "", "BIGINT", f"(SELECT count(*) FROM {name})")
    _define(spark, f"{name}_num_zeros", "", "BIGINT", f"{n} - (SELECT count(*) FROM {name})")
    _define(spark, f"{name}_rank1", "i BIGINT", "BIGINT", f"(SELECT count(*) FROM {name} WHERE pos < i)")
    _define(spark, f"{name}_rank0", "i BIGINT", "BIGINT", f"least(i, {n}) - (SELECT count(*) FROM {name} WHERE pos < i)")
    _define(spark, f"{name}_try_get", "i BIGINT", "BIGINT", f"if(i >= 0 AND i < {n}, (SELECT count(*) FROM {name} WHERE pos = i), NULL)")
    for which, rows in (("1", name), ("0", zeros)):
        _define(spark, f"{name}_try_select{which}", "k BIGINT", "BIGINT", f"(SELECT max(pos) FROM (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS r FROM {rows}) WHERE r = k)")
    for which in ("get(i", "select1(k", "select0(k"):
        f, a = which.split("(")
        _define(spark, f"{name}_{f}", f"{a} BIGINT", "BIGINT", f"coalesce({name}_try_{f}({a}), raise_error('{name}_{f}: no such position'))")


def register_multiset(spark: SparkSession, name: str, multi: MultiSet) -> None:
    """``<name>_rank1(i)``, ``_unique_rank1(i)``, ``_unique_rank0(i)``, ``_get(i)``, ``_select1(k)`` and ``_try_select1(k)``,
    ``_universe_size()``, ``_num_ones()``, ``_num_unique_ones()``, ``_num_zeros()``; the counts are the view ``<name>``."""
    multi.counts.createOrReplaceTempView(name)
    n = f"CAST({multi.universe} AS BIGINT)"
    below = f"FROM {name} WHERE pos < i"
    _define(spark, f"{name}_universe_size", "", "BIGINT", n)
    _define(spark, f"{name}_num_ones", "", "BIGINT", f"(SELECT coalesce(sum(cnt), 0) FROM {name})")
    _define(spark, f"{name}_num_unique_ones", "", "BIGINT", f"(SELECT count(*) FROM {name})")
    _define(spark, f"{name}_num_zeros", "", "BIGINT", f"{n} - (SELECT count(*) FROM {name})")
    _define(spark, f"{name}_get", "i BIGINT", "BIGINT", f"(SELECT coalesce(sum(cnt), 0) FROM {name} WHERE pos = i)")
    _define(spark, f"{name}_rank1", "i BIGINT", "BIGINT", f"(SELECT coalesce(sum(cnt), 0) {below})")
    _define(spark, f"{name}_unique_rank1", "i BIGINT", "BIGINT", f"(SELECT count(*) {below})")
    _define(spark, f"{name}_unique_rank0", "i BIGINT", "BIGINT", f"least(i, {n}) - (SELECT count(*) {below})")
    _define(spark, f"{name}_try_select1", "k BIGINT", "BIGINT", f"(SELECT max(pos) FROM (SELECT pos, cnt, sum(cnt) OVER (ORDER BY pos) AS upto FROM {name}) WHERE upto - cnt <= k AND k < upto)")
    _define(spark, f"{name}_select1", "k BIGINT", "BIGINT", f"coalesce({name}_try_select1(k), raise_error('{name}_select1: no such position'))")


def register_sequence(spark: SparkSession, name: str, sequence: Sequence) -> None:
    """``<name>_try_get(i)``, ``_count(lo, hi, symbol)``, ``_preceding_count(lo, hi, symbol)``, ``_try_select(lo, hi,
    symbol, k, ignore_bits)``, ``_try_select_last(...)``, ``_try_simple_majority(lo, hi)``, ``_max_symbol()``, each
    ``try_`` form also without it; table functions ``_quantile(lo, hi, k)`` and ``_majority(lo, hi, parts)``. The
    sequence is the view ``<name>``."""
    sequence.seq.createOrReplaceTempView(name)
    inside = f"FROM {name} WHERE pos >= lo AND pos < hi"
    same = "shiftright(sym, ignore_bits) = shiftright(symbol, ignore_bits)"
    _define(spark, f"{name}_max_symbol", "", "BIGINT", f"CAST({sequence.max_symbol} AS BIGINT)")
    _define(spark, f"{name}_try_get", "i BIGINT", "BIGINT", f"(SELECT max(sym) FROM {name} WHERE pos = i)")
    _define(spark, f"{name}_count", "lo BIGINT, hi BIGINT, symbol BIGINT", "BIGINT", f"(SELECT count(*) {inside} AND sym = symbol)")
    _define(spark, f"{name}_preceding_count", "lo BIGINT, hi BIGINT, symbol BIGINT", "BIGINT", f"(SELECT count(*) {inside} AND sym < symbol)")
    for f, order in (("select", "pos"), ("select_last", "pos DESC")):
        _define(spark, f"{name}_try_{f}", "lo BIGINT, hi BIGINT, symbol BIGINT, k BIGINT, ignore_bits INT", "BIGINT", f"(SELECT max(pos) FROM (SELECT pos, row_number() OVER (ORDER BY {order}) - 1 AS r {inside} AND {same}) WHERE r = k)")
    _define(spark, f"{name}_try_simple_majority", "lo BIGINT, hi BIGINT", "BIGINT", f"(SELECT max(sym) FROM (SELECT sym, count(*) AS c {inside} GROUP BY sym) WHERE 2 * c > least(hi, {sequence.length}) - lo)")
    for f, arguments in (("get", "i"), ("select", "lo, hi, symbol, k, ignore_bits"), ("select_last", "lo, hi, symbol, k, ignore_bits"), ("simple_majority", "lo, hi")):
        typed = ", ".join(f"{a} {'INT' if a == 'ignore_bits' else 'BIGINT'}" for a in arguments.split(", "))
        _define(spark, f"{name}_{f}", typed, "BIGINT", f"coalesce({name}_try_{f}({arguments}), raise_error('{name}_{f}: no answer'))")
    hist = f"(SELECT sym, count(*) AS c {inside} GROUP BY sym)"
    _define(spark, f"{name}_quantile", "lo BIGINT, hi BIGINT, k BIGINT", "TABLE(symbol BIGINT, cnt BIGINT)", f"SELECT sym, c FROM (SELECT sym, c, sum(c) OVER (ORDER BY sym) AS upto FROM {hist}) WHERE upto - c <= k AND k < upto")
    _define(spark, f"{name}_majority", "lo BIGINT, hi BIGINT, parts BIGINT", "TABLE(symbol BIGINT, cnt BIGINT)", f"SELECT sym, c FROM {hist} WHERE c * parts > least(hi, {sequence.length}) - lo")
