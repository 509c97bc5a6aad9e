"""Every registered query of the library against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tessera.plans import charts, domain, facts, relational, statistics, streams

MODULES = (relational, domain, statistics, streams, charts, facts)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return c


def test_no_name_is_registered_twice():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    cur = con.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, cur.fetchall())
