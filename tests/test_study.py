"""Evaluation queries against brute force, where their size tells more than the given tables do."""

import hashlib

import numpy as np
import pytest
from loomdex.operators import retrieval as R
from loomdex.operators.index import build_index
from loomdex.plans import study_queries as P
from loomdex.shared import exists
from test_postings import shuffled_rows


def test_bootstrap_of_ten_thousand_repetitions(spark, tiny, monkeypatch):
    """The interval is that of 10,000 resamples, as the method has it."""
    deltas = [((i * 37) % 101) / 100 - 0.4 for i in range(23)]
    frame = lambda values: spark.createDataFrame(list(enumerate(values)), "query_id long, rr double")
    monkeypatch.setattr(P, "_pair", lambda *_: (frame(deltas), frame([0.0] * len(deltas))))

    def interval(reps):
        draw = lambda rep, i: deltas[int(hashlib.md5(f"{rep}:{i}".encode()).hexdigest()[:8], 16) % len(deltas)]
        means = sorted(sum(draw(rep, i) for i in range(len(deltas))) / len(deltas) for rep in range(reps))
        return round(means[reps * 25 // 1000], 6), round(means[reps * 975 // 1000], 6)

    assert interval(2_000) != interval(10_000)
    assert tuple(P.bootstrap_ci(spark, tiny).first()) == interval(10_000)
    assert "range(10000)" in P.SQL["bootstrap_ci"]


def test_many_queries_shuffle_no_row_a_segment(spark):
    """Every segment has a word of every query: what moves grows with the queries, not with queries times segments."""
    texts = [(i, f"all w{i % 50} own{i}") for i in range(800)]
    index = build_index(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), dim=0, segment=8)
    n = R.SCORED_QUERIES + 100
    queries = spark.createDataFrame([(i, f"all w{i % 50} own{i % 800}") for i in range(n)], "query_id long, text string")
    found, moved = shuffled_rows(spark, lambda: R.bm25_top_k(queries, index, 3).where("rank = 0").select("query_id", "id").collect())
    assert index.blocks.select("segment").distinct().count() >= 100
    assert sorted(map(tuple, found)) == [(i, i % 800) for i in range(n)] and moved < 40 * n


@pytest.mark.parametrize("rows, lead, word_docs", [(2048, 8, 512), (7, 1, 3)])
def test_many_queries_get_what_each_gets_alone(spark, monkeypatch, rows, lead, word_docs):
    """Words that name no documents, floors and the order of documents change no result: ties, repeated ids and words, long and empty texts."""
    rng, names = np.random.default_rng(5), [f"w{i}" for i in range(300)]
    weight = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(names, int(rng.integers(0, 60)), p=weight / weight.sum())) for _ in range(1500)] + [None, "", "w0 " * 300, "w7 w8", "w7 w8"]
    docs = [(i % 1490, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    asked = ["w0", "w0 w0 w1", "w299 w0 w1 w2", "nowhere", "", "w7 w8"] + [" ".join(rng.choice(names, 6, p=weight / weight.sum())) for _ in range(80)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    whole, bare = build_index(frame, dim=0, segment=64), build_index(frame, dim=0, inverted=False)
    found = lambda index, k: sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in R.bm25_top_k(queries, index, k).collect())
    alone = {k: found(whole, k) for k in (1, 8, 40)}
    for name, value in (("BATCH_QUERIES", 0), ("BATCH_ROWS", rows), ("LEAD_DOCS", lead), ("LEAD_WORD_DOCS", word_docs)):
        monkeypatch.setattr(R, name, value)
    assert {k: found(bare, k) for k in alone} == alone
    assert not exists(spark, bare.path) and bare.blocks.count() > 0 and exists(spark, bare.path)
    totals = lambda index: sorted(map(tuple, index.words.select("token", "df", "total").collect()))
    assert totals(bare) == totals(whole)
