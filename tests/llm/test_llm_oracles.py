"""The queries of the subpackage that SQL expresses, against their DuckDB oracles."""

from pathlib import Path

import duckdb
import pytest
from loomdex.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, tiny, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations", "labels", "embeddings"):
        path = Path(f"{tiny}/{table}.parquet")
        connection.execute(f"create view {table} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    frame = queries()[name](spark, tiny)
    found = connection.execute(oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert set(columns) <= set(frame.columns)
    assert sorted(map(tuple, frame.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)
