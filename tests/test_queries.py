"""Every registered query against the SQL it must equal, on whole tables."""

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def text_of(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return "null" if value is None else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(text_of(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query(spark, sf_dir, engine, name):
    df = driver.queries()[name](spark, sf_dir)
    result = engine.sql(driver.oracle_sql()[name])
    expected = canonical(result.columns, result.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())
