"""Registered queries against their SQL on the smallest tables (skipped where those are absent)."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from rankweave.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: one or two of each family; the others are compared by the driver
SOME = ["wm_quantile", "wm_counts_ignore_bits", "wm_locate", "wm_morton_count_batch_2d", "bv_ranks", "rle_runs", "elias_fano_encode", "mbv_select1", "zorder_split_bbox", "h2_quantile", "spatial_ids_for_bbox", "bic_roundtrip", "bits_misc"]

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    ours = QUERIES[name](spark, DATA).toArrow()
    answer = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(ours.column_names) == sorted(names)
    rows = zip(*[ours.column(c).to_pylist() for c in names], strict=True)
    assert sorted(map(repr, rows)) == sorted(map(repr, answer.fetchall())) and ours.num_rows


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 or DATA != "/root/testdata/sf0.001"
    assert set(ORACLE_SQL) <= set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries())
