"""Every registered query of the corpus engine against DuckDB, over whole tables."""

import math

import duckdb
import pytest

from quillstack.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "lineitem orders part events documents benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(rows, columns):
    def value(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(value(r[c]) for c in columns) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert plain(df.collect(), columns) == plain(expected, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
