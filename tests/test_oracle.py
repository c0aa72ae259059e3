"""Every query with a SQL form must give the SQL answer on the given tables."""

import math
import os

import duckdb
import pytest

from cytoweave.plans import registry

registry.load_all()

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def tidy(value):
    if value is None:
        return None
    if type(value).__name__ == "Decimal":
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    ref = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in ref.description]
    want = ref.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, got) == table(names, want)


NO_SQL = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.mark.parametrize("name", NO_SQL)
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_names_are_unique_and_covered():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.ORACLES) > 130
