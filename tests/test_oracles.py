"""Every registered query of the engine against its DuckDB oracle; those without one have to run."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest
from loomdex import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(f"{tiny}/{name}.parquet")
        connection.execute(f"create view {name} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, tiny, name):
    frame = registry.queries()[name](spark, tiny)
    got = rows_of(frame.columns, frame.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    expected = duck.execute(sql)
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(frame.columns)
    assert got == rows_of(names, expected.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.columns == ["query_id", "id", "score", "rank"] and frame.count() > 0
    assert set(registry.queries()) <= set(entry.queries())
