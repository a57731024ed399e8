"""Every registered query of the library against its SQL on the small driver tables."""

import glob
import os

import duckdb
import pytest

from shutterlake.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return round(float(value), 5)
    return value


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in ORACLE_SQL:
        return
    wanted = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in places) for r in wanted.fetchall()), key=repr)


def test_entry_without_corpus_queries(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
