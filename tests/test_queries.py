"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from sightline.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    if hasattr(value, "__iter__") and not isinstance(value, str):
        return str(list(value))
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    frame = registry.queries()[name](spark, FOLDER)
    result = oracle.execute(registry.oracle_sql()[name])
    assert rows(frame.columns, frame.collect()) == rows([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, FOLDER).count() > 0
