"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as registry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


LARGER = "/root/testdata/sf0.01"


def connect(folder):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def rows(cells, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else v + 0.0
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in cells), key=repr)


def compare(spark, duck, name, folder):
    df = QUERIES[name](spark, folder)
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, name, FOLDER)


@pytest.mark.parametrize("name", ["numeric_stats", "numeric_stats_nulls", "shapiro_wilk", "uniform_sample", "pair_grid"])
def test_larger_tables_match_sql(spark, name):
    compare(spark, connect(LARGER), name, LARGER)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert registry.entry(spark).count() == 8
