"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from textlist.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    """Their values are held in test_matching.py and test_samples_and_streams.py."""
    df = registry.QUERIES[name](spark, sf)
    found = [tuple(r) for r in df.collect()]
    assert found and len(set(map(repr, found))) == len(found)
