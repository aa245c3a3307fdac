"""Registration, and query parameters that both engines read from the same text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the DuckDB SQL that states its result by the naive definition."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


#: Sequences of the driver's tables, as SQL.
EVENTS = "s AS (SELECT event_id AS pos, user_id AS sym FROM events)"
ORDERS = "s AS (SELECT o_orderkey AS pos, o_custkey AS sym FROM orders)"
PARTS = "s AS (SELECT p_partkey AS pos, CAST(p_size AS BIGINT) AS sym FROM part)"

#: qid, range in 64ths of the length, symbol in 64ths of the alphabet, small k, ignored bits
RANGE_ROWS = [
    (0, 0, 64, 0, 0, 0), (1, 0, 64, 32, 3, 0), (2, 16, 48, 10, 1, 0), (3, 16, 48, 63, 0, 1), (4, 5, 6, 20, 2, 0), (5, 40, 64, 50, 7, 2),
    (6, 33, 33, 12, 0, 0), (7, 63, 64, 5, 0, 3), (8, 1, 63, 40, 20, 0), (9, 8, 24, 25, 4, 1), (10, 0, 1, 32, 0, 2), (11, 20, 60, 60, 11, 0),
]


def values(rows: list[tuple], *names: str) -> str:
    """A VALUES relation that Spark and DuckDB both read."""
    body = ", ".join("(" + ", ".join(str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(names)})"


def range_params(rows: list[tuple] = RANGE_ROWS) -> str:
    """CTEs ``nn(n, m)`` and ``q(qid, lo, hi, symbol, k, j, ignore_bits)`` over ``s(pos, sym)``; k is the
    middle of the range moved by j."""
    at = lambda c: f"CAST(floor(n * {c} / 64.0) AS BIGINT)"
    return f"""nn AS (SELECT count(*) AS n, max(sym) AS m FROM s),
q AS (SELECT CAST(qid AS BIGINT) AS qid, {at("a")} AS lo, {at("b")} AS hi, CAST(floor((m + 1) * c / 64.0) AS BIGINT) AS symbol,
  CAST(floor(({at("b")} - {at("a")}) / 2.0) AS BIGINT) + j AS k, CAST(j AS BIGINT) AS j, CAST(ig AS BIGINT) AS ignore_bits
  FROM nn CROSS JOIN {values(rows, "qid", "a", "b", "c", "j", "ig")})"""


def ask(spark: SparkSession, seq: DataFrame, ctes: str, select: str = "SELECT * FROM q") -> DataFrame:
    """Query parameters computed by Spark from a sequence and the shared text."""
    return spark.sql(f"WITH s AS (SELECT * FROM {{seq}}), {ctes} {select}", seq=seq)


def literal(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small parameter table of BIGINTs."""
    return spark.createDataFrame([tuple(int(v) for v in r) for r in rows], ", ".join(f"{n} long" for n in names))
