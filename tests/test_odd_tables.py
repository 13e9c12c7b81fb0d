"""Queries against their DuckDB oracles on small tables of rows that the given ones lack."""

import duckdb
import pytest
from loomdex import registry


@pytest.fixture
def against_sql(spark, tmp_path):
    """Rows of a query over tables {name: (schema, rows)}, Spark's and the oracle's."""

    def rows(name, tables):
        connection = duckdb.connect()
        for table, (schema, values) in tables.items():
            path = str(tmp_path / f"{table}.parquet")
            spark.createDataFrame(values, schema).coalesce(1).write.parquet(path)
            connection.execute(f"create view {table} as select * from '{path}/*.parquet'")
        got = registry.queries()[name](spark, str(tmp_path))
        expected = connection.execute(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, got.collect()), key=repr), sorted(expected, key=repr)

    return rows


def test_heading_lines_without_numbered_ones(against_sql):
    texts = ["20.118.157.107 Betz das mit.oark", "1.2 Scope\nSCOPE OF WORK\n3. NEXT\nA Title Line\ntext", "A Line That Stops.\r\nbody", "2 Parts"]
    got, expected = against_sql("heading_lines", {"documents": ("doc_id long, text string", list(enumerate(texts)))})
    assert got == expected and (1, 1, 1) in got and not [r for r in got if r[0] in (0, 3)]


def test_links_of_pages_of_one_url(against_sql):
    """Copies of an url are ranked together, by place and page: the first five plain links of all, and every result."""
    links = lambda *names: "".join(f'<a href="/{n}">label of link {n}</a>' for n in names)
    pages = [(1, "http://a.org/", links("p1", "p2", "p3", "p4")), (2, "http://a.org/", '<a href="mailto:x">no link, but a place</a>' + "<a href='/s'>short</a>" + links("q1", "q2", "q3", "q4", "q5", "q6")), (3, "http://a.org/", ""), (6, "http://a.org/", ""), (4, "http://b.org/", links("r1"))]
    got, expected = against_sql("serp_links", {"pages": ("page_id long, url string, html string", pages)})
    # (url, rank, title, link, snippet): the oracle leaves open which of two pages comes first at one place
    assert sorted(r[:2] for r in got) == sorted(r[:2] for r in expected)
    assert [r[2][-2:] for r in got if r[0] == "http://a.org/" and "label" in r[2]] == ["p1", "p2", "p3", "q1", "p4"]
    assert sorted(r[1] for r in got if "Page" in r[2]) == [1, 2]


def test_words_are_cut_in_small_slices(monkeypatch):
    """A slice of text at a time, whatever the batch; the same words, lengths and vectors as in one."""
    import numpy as np
    import pyarrow as pa
    from loomdex.operators import index as X

    assert X.SLICE_BYTES <= 4 << 20
    texts = ["b a a", None, "", "Über x " * 50, "c " * 30, "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["id", "text"])
    whole = pa.Table.from_batches(X._counted_rows(8)([batch])).to_pylist()
    monkeypatch.setattr(X, "SLICE_BYTES", 20)
    cut = list(X._counted_rows(8)([batch]))
    assert len(cut) > 3
    by_word = lambda r: (r["id"], r["n"], sorted(zip(r["words"], r["times"], strict=True)))
    parts = pa.Table.from_batches(cut).to_pylist()
    assert list(map(by_word, parts)) == list(map(by_word, whole))
    assert all(a["vector"] == b["vector"] or np.allclose(a["vector"], b["vector"]) for a, b in zip(parts, whole, strict=True))


def test_documents_are_inverted_once(spark, monkeypatch):
    """Building an index inverts the documents once: nothing samples the blocks before they are dealt."""
    from loomdex.operators import index as X

    runs, plain = spark.sparkContext.accumulator(0), X._posting_blocks

    def watched(segment):
        rows = plain(segment)

        def counted(batches):
            for b in rows(batches):
                runs.add(b.num_rows)
                yield b

        return counted

    monkeypatch.setattr(X, "_posting_blocks", watched)
    frame = spark.createDataFrame([(i, f"w{i % 7} all") for i in range(40)], "doc_id long, text string")
    assert X.build_index(frame, segment=8).blocks.count() == runs.value


def test_documents_are_packed_a_few_at_a_time():
    """However many documents a batch has, a few are Python objects at once; chunks are those of each document alone."""
    import pyarrow as pa
    from loomdex.operators import chunking as C

    unit = {"pos": 0, "trail": None, "page": None, "text": "Some words of a block. " * 40, "sentences": ["Some words of a block. "] * 40}
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("trail", pa.string()), ("page", pa.int64()), ("text", pa.string()), ("sentences", pa.list_(pa.string()))]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([[unit]] * 100, kind)], ["id", "units"])
    parts = list(C._packed_rows(C.Sizes())([batch]))
    assert len(parts) > 2 and all(len(p.column("id").unique()) <= C.PACK_ROWS for p in parts)
    rows = pa.Table.from_batches(parts).to_pylist()
    alone = C.pack_document([unit | {"trail": ""}], C.Sizes())
    assert [(r["id"], r["index"], r["body"]) for r in rows] == [(i, n, c["body"]) for i in range(100) for n, c in enumerate(alone)]


def test_embedding_tells_the_pieces_of_a_text(spark):
    """Their number comes with the vector, also of texts that stand twice: nobody has to cut the texts again."""
    import numpy as np
    from loomdex.operators import vectors as V

    rows = [(1, "short"), (2, "line of text\n" * 30), (2, "line of text\n" * 30), (3, None)]
    frame = spark.createDataFrame(rows, "id long, text string")
    got = V.embed_batches(frame, "id", "text", lambda t: np.ones((len(t), 2)), 2, budget=100).collect()
    cut = {r.id: r.n for r in frame.select("id", V.F.size(V.text_pieces(V.F.col("text"), 100)).alias("n")).collect()}
    assert sorted((r.id, r.pieces) for r in got) == sorted((i, cut[i]) for i, _ in rows)
