"""Postings in buckets, their bounds, and BM25 that prunes by them."""

import re
from pathlib import Path

import numpy as np
import pytest
from loomdex.operators import retrieval as R
from loomdex.operators.index import build_index, postings
from loomdex.plans import retrieval_queries as Q
from loomdex.shared import exists, release
from loomdex.sources.tables import version
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark):
    """200 documents of common and rare words, in segments of eight, some without words and two of one id."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)] + ["Übung", "日本"]
    weight = 1 / np.arange(1, 43)
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 40)), p=weight / weight.sum())) for _ in range(200)] + [None, "", "...", "w1 " * 50]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "w1 w2 w39"), (7, "w1 w2 w39")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    return rows, build_index(frame, segment=8)


def split(text):
    return [w for w in re.split(r"[^\w]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def test_blocks_hold_all_postings(corpus):
    rows, index = corpus
    expected = sorted((w, i, split(t).count(w), len(split(t))) for i, t in rows for w in set(split(t)))
    assert sorted(map(tuple, postings(index).collect())) == expected
    for r in index.blocks.collect():
        assert (r["size"], r.total, r.max_tf, r.min_n) == (len(r.ids), sum(r.tfs), max(r.tfs), min(r.lengths)) and r["size"] <= 8
        assert len(set(r.places)) == len(r.places) == len(r.ids)
    assert {(r.token, r.df) for r in index.words.collect()} == {(w, sum(w in split(t) for _, t in rows)) for w, *_ in expected}


def test_words_lie_in_their_bucket(corpus):
    _, index = corpus
    assert index.blocks.where(F.col("bucket") != index.bucket_of(F.col("token"))).count() == 0


def brute(rows, text, k):
    own = [(i, split(t)) for i, t in rows]
    mean, total = sum(len(w) for _, w in own) / len(own), len(own)
    found = []
    for i, words in own:
        score = 0.0
        for w in split(text):
            df = sum(w in x for _, x in own)
            score += np.log((total - df + 0.5) / (df + 0.5) + 1) * words.count(w) * 2.5 / (words.count(w) + 1.5 * (0.25 + 0.75 * len(words) / mean))
        if score > 0:
            found.append((-round(score, 9), i))
    return [(i, n) for n, (_, i) in enumerate(sorted(found)[:k])]


@pytest.mark.parametrize("first", [1, 3, 1000])
def test_pruned_top_k_is_that_of_all(spark, corpus, first):
    rows, index = corpus
    asked = ["w39 w38", "w0 w1 w2 w3 w3", "übung w20", "日本", "nowhere", "", "w12 w33 nowhere w0"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {q: [] for q in range(len(asked))}
    for r in R.bm25_top_k(queries, index, 5, first=first).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r["rank"]))
    assert got == {q: brute(rows, t, 5) for q, t in enumerate(asked)}


def test_segments_out_of_reach_are_not_scored(spark, corpus, monkeypatch):
    """A rare word decides: few segments hold it, and those without it cannot reach its documents' scores."""
    rows, index = corpus
    queries, sent = spark.createDataFrame([(0, "w39 w0")], "query_id long, text string"), []
    plain = R._scored_segments
    counted = spark.sparkContext.accumulator(0)

    def watched(*args):
        score = plain(*args)

        def segment(blocks, asking):
            counted.add(1)
            return score(blocks, asking)

        return segment

    monkeypatch.setattr(R, "_scored_segments", watched)
    got = [(r.id, r["rank"]) for r in R.bm25_top_k(queries, index, 2, first=2).orderBy("rank").collect()]
    pruned = counted.value
    sent += [(r.id, r["rank"]) for r in R.bm25_top_k(queries, index, 2, first=10_000).orderBy("rank").collect()]
    every = index.blocks.where("token in ('w39', 'w0')").select("segment").distinct().count()
    assert got == sent == brute(rows, "w39 w0", 2) and pruned < every == counted.value - pruned


def test_only_buckets_of_query_words_are_read(spark, corpus):
    _, index = corpus
    words = spark.createDataFrame([("w3",), ("w39",)], "token string")
    scan = index.blocks_of(words, 10)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    wanted = {r[0] for r in words.select(index.bucket_of(F.col("token"))).collect()}
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert set(r[0] for r in scan.select("bucket").distinct().collect()) <= wanted


def shuffled_rows(spark, run):
    """Rows that the stages of a run wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (lambda all: [all.apply(i) for i in range(all.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = stages()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for key, n in stages().items() if key not in before)


def test_blocks_of_other_words_are_not_shuffled(spark):
    """20,000 blocks of words that nobody asks for lie in the buckets that are read; only those of the two words asked for move."""
    texts = [(i, " ".join(f"own{i}x{j}" for j in range(100)) + (" apple" if i % 2 else " pear")) for i in range(200)]
    index = build_index(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), segment=8)
    queries = spark.createDataFrame([(0, "apple pear")], "query_id long, text string")
    found, moved = shuffled_rows(spark, lambda: R.bm25_top_k(queries, index, 300).count())
    assert found == 200 and moved < 2_000


def test_a_large_batch_of_queries_is_one_pass(spark, corpus, monkeypatch):
    """3,000 queries read the postings once for their best segments and once for the others; scores are held for some of them at a time."""
    rows, index = corpus
    asked = [f"w{i % 40} w{i % 7} none{i}" for i in range(3000)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    passes, plain = [], R._pruned_top_k
    monkeypatch.setattr(R, "_pruned_top_k", lambda *args: passes.append(1) or plain(*args))
    got = {q: [] for q in range(len(asked))}
    for r in R.bm25_top_k(queries, index, 3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r["rank"]))
    assert len(passes) == 1
    best = {text: brute(rows, text, 3) for text in {" ".join(t.split()[:2]) for t in asked}}
    assert got == {q: best[" ".join(t.split()[:2])] for q, t in enumerate(asked)}


def test_ablation_scores_its_segments_once(spark, tiny, monkeypatch):
    """A segment is scored at most twice: for the queries that have it among their best, and for others that it may still serve."""
    from loomdex.plans import study_queries as P

    built, plain, counted = [], R._scored_segments, spark.sparkContext.accumulator(0)

    def watched(*args):
        score = plain(*args)
        return lambda blocks, asking: counted.add(1) or score(blocks, asking)

    monkeypatch.setattr(R, "_scored_segments", watched)
    monkeypatch.setattr(P, "build_index", lambda docs: built.append(build_index(docs, segment=8)) or built[-1])
    assert P.ablation(spark, tiny).count() == 2
    segments = sum(x.blocks.select("segment").distinct().count() for x in built)
    assert len(built) == 2 and 0 < counted.value <= 2 * segments


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    import pyarrow as pa
    from loomdex.operators import index as X

    texts = ["één twee", None, "drie " * 20, "", "日本 Über.ÄB", "vijf vijf", "naïve É", "ten " * 9]
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "text": texts})
    pieces = list(X._pieces(batch, 12))
    assert [i for p in pieces for i in p["id"].to_pylist()] == list(range(8)) and len(pieces) > 3
    count = lambda b: [r for out in X._counted_rows(8)([b]) for r in out.to_pylist()]
    whole = count(batch)
    monkeypatch.setattr(X, "SLICE_BYTES", 12)
    assert count(batch) == whole and count(batch.slice(3)) == whole[3:]
    assert [dict(zip(r["words"], r["times"])) for r in whole[:1] + whole[4:7]] == [{"één": 1, "twee": 1}, {"日本": 1, "Über": 1, "Äb": 1}, {"vijf": 2}, {"naïve": 1, "É": 1}]


def test_workers_get_a_segment_at_a_time(spark, tmp_path, monkeypatch):
    """Neither texts nor counted documents come in the batches of the session, which grow with the files; its setting is back afterwards."""
    from loomdex.operators import index as X

    def watched(plain, name):
        def outer(*args):
            rows = plain(*args)

            def noted(batches):
                for b in batches:
                    with open(f"{tmp_path}/{name}", "a") as f:
                        f.write(f"{len(b)}\n")
                    yield b

            return lambda batches: rows(noted(batches))

        return outer

    for name in ("_counted_rows", "_posting_blocks"):
        monkeypatch.setattr(X, name, watched(getattr(X, name), name))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    texts = [(i, f"w{i % 7} own{i}") for i in range(100)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    before = spark.conf.get(setting)
    index = X.build_index(frame, segment=16)
    for name in ("_counted_rows", "_posting_blocks"):
        sizes = [int(n) for n in Path(f"{tmp_path}/{name}").read_text().split()]
        assert sum(sizes) == 100 and max(sizes) <= 16, name
    assert spark.conf.get(setting) == before
    assert index.blocks.select("segment").distinct().count() == 7
    assert sorted(map(tuple, postings(index).collect())) == sorted((w, i, 1, 2) for i, t in texts for w in t.split())
    # a smaller batch that the session asks for stays, no limit is not one, and an error puts the setting back
    for own, seen in (("4", "4"), ("0", "16")):
        spark.conf.set(setting, own)
        try:
            with pytest.raises(ZeroDivisionError), X.arrow_rows(spark, 16):
                assert spark.conf.get(setting) == seen
                1 / 0
            assert spark.conf.get(setting) == own
        finally:
            spark.conf.set(setting, before)


def test_a_rewritten_table_gets_a_new_index(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "apple tree")], "doc_id long, text string").write.parquet(path)
    before, old = version(spark, str(tmp_path), "documents"), Q.index(spark, str(tmp_path))
    assert Q.index(spark, str(tmp_path)) is old
    spark.createDataFrame([(1, "plum"), (2, "pear")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    assert version(spark, str(tmp_path), "documents") != before and Q.index(spark, str(tmp_path)).size == 2
    assert Path(path).exists()


def test_what_a_session_wrote_can_be_released(spark, tmp_path):
    spark.createDataFrame([(1, "apple tree")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    held = Q.index(spark, str(tmp_path))
    assert exists(spark, held.path) and release(spark) > 0 and not exists(spark, held.path)
    again = Q.index(spark, str(tmp_path))
    assert again is not held and again.words.count() == 2
