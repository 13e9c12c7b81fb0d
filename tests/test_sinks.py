"""The keyed table and the extractors' table function."""

from pathlib import Path

import pytest
from loomdex.sources.extract import EXTRACTORS, extract_blocks, extractor
from loomdex.sources.sink import KeyedTable
from pyspark.sql.types import StructType


def keyed(spark, path, buckets=16):
    return KeyedTable(spark, str(path), StructType.fromDDL("id long, version long, part int, vector array<double>"), "id", "version", buckets)


def rows(spark, *rows):
    return spark.createDataFrame(rows, "id long, version long, part int, vector array<double>")


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def stored(table):
    return sorted((r.id if r.id is not None else -1, r.version, r.part) for r in table.read().collect())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = keyed(spark, tmp_path / "t")
    assert table.read().collect() == [] and table.upsert(rows(spark).limit(0)) == []
    table.upsert(rows(spark, *[(i, 1, p, [1.0]) for i in range(60) for p in range(3)]))
    before = files(tmp_path / "t")
    touched = table.upsert(rows(spark, (7, 2, 0, [2.0]), (7, 2, 1, [2.0]), (99, 1, 0, [3.0])))
    after = files(tmp_path / "t")
    changed = {name.split("/")[0] for name in before.keys() ^ after.keys()} | {name.split("/")[0] for name in before.keys() & after.keys() if before[name] != after[name]}
    assert changed == {f"__bucket={b}" for b in touched} and 1 <= len(touched) <= 2 < len({n.split("/")[0] for n in before})
    assert stored(table) == sorted([(i, 1, p) for i in range(60) if i != 7 for p in range(3)] + [(7, 2, 0), (7, 2, 1), (99, 1, 0)])


def test_versions_and_deletions(spark, tmp_path):
    table = keyed(spark, tmp_path / "t", 2)
    table.upsert(rows(spark, (1, 2, 0, [1.0]), (1, 1, 7, [1.0]), (2, 1, 0, [1.0]), (None, 1, 0, [1.0])))
    assert stored(table) == [(-1, 1, 0), (1, 2, 0), (2, 1, 0)]
    # an older version is passed over, an equal one replaces, and repeating a write changes nothing
    for _ in range(2):
        table.upsert(rows(spark, (1, 1, 5, [1.0]), (2, 1, 3, [1.0]), (2, 1, 4, [1.0]), (None, 2, 9, [1.0])))
        assert stored(table) == [(-1, 2, 9), (1, 2, 0), (2, 1, 3), (2, 1, 4)]
    table.delete(rows(spark, (1, 1, 0, None), (2, 5, 0, None)))
    assert stored(table) == [(-1, 2, 9), (1, 2, 0)]
    table.upsert(rows(spark, (2, 4, 0, [1.0])))
    table.upsert(rows(spark, (2, 6, 6, [1.0])))
    assert stored(table) == [(-1, 2, 9), (1, 2, 0), (2, 6, 6)]


def test_wrong_vectors_fail_before_anything_is_stored(spark, tmp_path):
    table = keyed(spark, tmp_path / "t", 4)
    table.upsert(rows(spark, (1, 1, 0, [1.0, 2.0])), checks={"vector": 2})
    before = files(tmp_path / "t")
    for vector in ([1.0], None):
        with pytest.raises(Exception, match="length"):
            table.upsert(rows(spark, (2, 1, 0, [1.0, 2.0]), (1, 2, 0, vector)), checks={"vector": 2})
    assert files(tmp_path / "t") == before


def test_table_function_of_formats(spark):
    data = [(1, "Text", b" a  b\n\n\n c"), (2, "CSV", b'x\ty\n"1\n2"\t\n\t\n'), (3, "Mail", b"Subject: S\n\nbody text"), (4, "Text", None), (5, None, b"x"), (6, "Own", b"zz"), (7, "Own", b""), (8, "Text", b"\xff"), (9, "CSV", b"only,names\n")]
    frame = spark.createDataFrame(data, "id long, format string, content binary")

    def own(content):
        yield "pre", 3, str(1 // len(content))

    got = extract_blocks(frame, EXTRACTORS | {"Own": own})
    assert got.columns == ["id", "format", "pos", "kind", "level", "text", "error"]
    found = sorted((r.id, r.pos, r.kind, r.level, r.text, r.error and r.error.partition(":")[0]) for r in got.collect())
    assert found == [
        (1, 0, "paragraph", None, "a b", None), (1, 1, "paragraph", None, "c", None), (2, 0, "row", None, "x: 1 2", None), (3, 0, "heading", 1, "S", None), (3, 1, "paragraph", None, "body text", None),
        (4, None, None, None, None, "ValueError"), (5, None, None, None, None, "LookupError"), (6, 0, "pre", 3, "0", None), (7, None, None, None, None, "ZeroDivisionError"), (8, None, None, None, None, "UnicodeDecodeError"), (9, None, None, None, None, "ValueError"),
    ]
    assert extract_blocks(frame.limit(0)).collect() == []


def test_table_function_in_sql(spark):
    spark.udtf.register("file_blocks", extractor())
    spark.createDataFrame([(1, "Text", b"one\n\ntwo")], "id long, format string, content binary").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT f.id, b.pos, b.text FROM some_files f, LATERAL file_blocks(f.format, f.content) b").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "one"), (1, 1, "two")]
