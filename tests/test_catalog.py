"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from refsieve.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(catalog.ORACLES[name])
    order = sorted(got.columns)
    assert sorted(d[0] for d in cur.description) == order
    at = [next(i for i, d in enumerate(cur.description) if d[0] == c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in r) for r in got.select(*order).collect()), key=str) == want
    assert want, "an empty comparison shows nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
