"""Every registered query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from spanloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object)
    values = frame.where(frame.notna(), None).values.tolist()
    plain = [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in values]
    return columns, sorted(plain, key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
