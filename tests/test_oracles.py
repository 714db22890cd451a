"""Every registered core query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from quarry.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple("" if x is None else str(round(x, 6) if isinstance(x, float) else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf, db, name):
    own = registry.queries()[name](spark, sf)
    names = sorted(own.columns)
    cursor = db.execute(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()[name]})")
    assert plain(map(tuple, own.select(*names).collect())) == plain(cursor.fetchall())


def test_every_query_is_callable():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.FLAGSHIP in registry.queries()
