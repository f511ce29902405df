"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from millrace.queries import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    def one(v):
        if v is None or v != v:
            return "NULL"
        return repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    found = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        assert rows(found) == rows(db.sql(catalog.ORACLES[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
