"""Every query with an oracle equals DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import MODULES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    q = duck.execute(ORACLES[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in q.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle(spark, name):
    """Rows are there, reruns agree, and numbers are finite; the operators' values are tested on small tables."""
    one, two = ([tuple(map(plain, r)) for r in QUERIES[name](spark, SF).collect()] for _ in range(2))
    assert one and sorted(one) == sorted(two) and not any(v in ("inf", "-inf") for r in one for v in r)


@pytest.mark.parametrize("name", ["all_shortest_paths", "path_evidence"])
@pytest.mark.parametrize("second", [7, 1])
def test_paths_of_two_steps_alone(spark, tmp_path, name, second):
    """Suppliers 1 and 2 share a part, or (second = 7) meet over supplier 3 alone, four steps apart."""
    lines = [(1, 1, 1, 1), (2, 1, 3, 1), (3, 1, 3, 7), (4, 1, 2, second)]  # order, line, supplier, part
    dated = ", ".join(f"({o}, {n}, {s}, {p}, 5000.0, TIMESTAMP '1998-01-01')" for o, n, s, p in lines)
    c = duckdb.connect()
    c.execute(f"create table lineitem as from (values {dated}) t(l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_shipdate)")
    c.execute(f"copy (select * replace (l_extendedprice::double as l_extendedprice) from lineitem) to '{tmp_path}/lineitem.parquet'")
    q = c.execute(ORACLES[name])
    names = [d[0] for d in q.description]
    want = sorted(tuple(map(plain, r)) for r in q.fetchall())
    assert sorted(tuple(plain(r[k]) for k in names) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want
    assert bool(want) == (second == 1)


@pytest.mark.parametrize("name", ["all_shortest_paths", "path_evidence"])
def test_paths_none_left_out(spark, tmp_path, name):
    """Two suppliers with seven lines each of one part and one line each of another, two lines without an order: 50 paths."""
    lines = [(o, 1, o % 2 + 1, 7) for o in range(1, 13)] + [(13, 3, 2, 7), ("NULL", 1, 1, 8), (14, 1, 2, 8), ("NULL", 3, 1, 7)]
    dated = ", ".join(f"({o}, {n}, {s}, {p}, 5000.0, TIMESTAMP '1998-01-01')" for o, n, s, p in lines)
    c = duckdb.connect()
    c.execute(f"create table lineitem as from (values {dated}) t(l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_shipdate)")
    c.execute(f"copy (select * replace (l_extendedprice::double as l_extendedprice) from lineitem) to '{tmp_path}/lineitem.parquet'")
    q = c.execute(ORACLES[name])
    names = [d[0] for d in q.description]
    want = sorted(tuple(map(plain, r)) for r in q.fetchall())
    assert sorted(tuple(plain(r[k]) for k in names) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want
    assert name == "path_evidence" or len(want) == 50
