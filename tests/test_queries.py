"""Every registered query of the library itself against its SQL in DuckDB."""

import math

import duckdb
import pytest

from papyra.catalogue import ORACLE_SQL, QUERIES

TABLES = "customer orders lineitem events documents embeddings pages benchmark conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="session")
def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    own = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = duck.sql(ORACLE_SQL[name])
    at = [sql.columns.index(c) for c in columns]
    assert own == sorted((tuple(plain(r[k]) for k in at) for r in sql.fetchall()), key=repr)
    assert own


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
