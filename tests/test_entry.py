"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import catalogue
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if hasattr(x, "strftime"):
        return str(x)[:19]
    if type(x).__name__ in ("float", "Decimal"):
        return None if math.isnan(x) else float(f"{float(x):.8g}")
    return x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    names = sorted(got.columns)
    rows = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
        return
    made = duck.execute(sql)
    there = [c[0] for c in made.description]
    assert sorted(there) == names
    want = sorted((tuple(plain(r[there.index(n)]) for n in names) for r in made.fetchall()), key=repr)
    assert rows == want


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 6


def test_queries_and_oracles_have_the_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
