"""Casts of halves as DuckDB makes them."""

import duckdb

from wayline.plans import registry


def test_suppression_bands_of_exact_halves(spark, tmp_path):
    c = duckdb.connect()
    c.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey, 'S' || i AS s_name, CAST(i % 3 AS INT) AS s_nationkey, CAST(-2500 + 500 * (i % 25) AS DOUBLE) AS s_acctbal FROM range(60) t(i)")
    c.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet'")
    want = sorted(c.execute(registry.SQL["two_cell_suppression"]).fetchall(), key=str)
    got = registry.QUERIES["two_cell_suppression"](spark, str(tmp_path)).select("s_nationkey", "band", "n", "suppressed")
    assert sorted(map(tuple, got.collect()), key=str) == want
