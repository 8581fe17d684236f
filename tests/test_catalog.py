import math

import duckdb
import pytest

from tidewright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(v)[:10] if hasattr(v, "year") else round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def order(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-4 * max(1, abs(a))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    found = duck.sql(catalog.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert len(rows) == len(expected)
    for a, b in zip(sorted(rows, key=order), sorted(expected, key=order)):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)
