"""Every registered query of the engine against its SQL twin, on the smallest tables."""

import math

import duckdb
import pytest

from plumbline.plans import catalog, decisions  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    session = duckdb.connect()
    for name in (*catalog.TABLES, "embeddings", "pages"):
        session.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return session


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 8))
    return x.isoformat() if hasattr(x, "isoformat") else repr(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_as_in_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    asked = tables.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in asked.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in asked.fetchall())


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
