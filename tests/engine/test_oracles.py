"""Each query with SQL against DuckDB over the smallest tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from wayfarer import more_queries, queries

FOLDER = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@pytest.fixture(scope="module")
def duck():
    if not FOLDER.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float | Decimal):
        return round(float(value), 6)
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


assert more_queries.QUERIES is queries.QUERIES  # registers further queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_and_sql_agree(spark, duck, name):
    found = queries.QUERIES[name](spark, str(FOLDER))
    cursor = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(repr([plain(dict(zip(columns, r, strict=True))[c]) for c in order]) for r in cursor.fetchall())
    got = sorted(repr([plain(r[c]) for c in order]) for r in found.collect())
    assert got == want
