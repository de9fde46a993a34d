"""Every registered tracking query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from matchlake import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return [names[k] for k in order], sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    ran = duck.execute(catalog.oracle_sql()[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(ran.fetchall(), [c[0] for c in ran.description])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).columns
