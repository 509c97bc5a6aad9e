"""First rows of records whose order leaves ties."""

import duckdb

from tessera.plans import facts


def test_ties_go_by_place_in_the_files(spark, tmp_path):
    """The second file is the larger, so that Spark reads it first."""
    (tmp_path / "lineitem.parquet").mkdir()
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i % 3 AS o_orderkey, i % 2 AS o_custkey FROM range(6) t(i)) TO '{tmp_path}/orders.parquet'")
    line = "SELECT (i % 3)::BIGINT AS l_orderkey, (i // {n})::INT AS l_linenumber, {x} + i::DOUBLE AS l_quantity FROM range({n}) t(i)"
    con.execute(f"COPY ({line.format(n=30, x=0)}) TO '{tmp_path}/lineitem.parquet/a.parquet'")
    con.execute(f"COPY ({line.format(n=3000, x=1000)}) TO '{tmp_path}/lineitem.parquet/b.parquet'")
    got = facts.first_features(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k, c, float(k)) for k in range(3) for c in range(2)]
