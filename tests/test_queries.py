"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tracegrid.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


#: Queries that SQL can't express; other tests hold them against brute force.
NO_SQL = {"search_highlights"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    relation = db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    got = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    place = [relation.columns.index(c) for c in sorted(relation.columns)]
    want = sorted(tuple(shown(r[i]) for i in place) for r in relation.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) | NO_SQL
