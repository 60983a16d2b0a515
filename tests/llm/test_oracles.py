"""The corpus queries with SQL, against DuckDB on the smallest tables; the others must run."""

import os

import duckdb
import pytest
from sightline.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = queries.queries()[name](spark, FOLDER)
    result = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    plain = lambda row: tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in row)
    assert sorted(map(plain, frame.select(names).collect())) == sorted(map(plain, result.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries.queries()[name](spark, FOLDER).count() > 0
