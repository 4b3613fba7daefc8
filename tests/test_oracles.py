"""Every registered query against its SQL text on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else value if value is None or isinstance(value, (bool, int)) else str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_same_rows(spark, duck, data, name):
    df = entry_points.queries()[name](spark, data)
    found = sorted_rows(df.columns, df.collect())
    cursor = duck.execute(entry_points.oracle_sql()[name])
    rows = cursor.fetchall()
    assert found == sorted_rows([d[0] for d in cursor.description], rows)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
