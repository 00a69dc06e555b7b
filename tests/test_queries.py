"""The queries about plans, evidence, pages and pixels against their SQL, on the smallest tables."""

import duckdb
import pytest

from tourweave.queries import reread, stored, whole

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("orders", "customer", "part", "lineitem", "events", "nation"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in values)


ALL, STATED = whole.QUERIES | reread.QUERIES | stored.QUERIES, whole.SQL | reread.SQL | stored.SQL


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_and_sql_agree(spark, tables, name):
    found = ALL[name](spark, SF)
    stated = tables.sql(STATED[name])
    got, expected = rows(found.columns, found.collect()), rows(stated.columns, stated.fetchall())
    assert got == expected and expected[1]
