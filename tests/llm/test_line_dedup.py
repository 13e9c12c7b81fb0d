"""Line dedup against a brute-force version."""

import re
from collections import Counter

import numpy as np
import pytest
from loomdex.llm import line_dedup
from loomdex.llm.line_dedup import dedup_lines

SPACE = " \t\n\v\f\r"


def brute(rows, least=10, chars=1, keep_first=False):
    """(id, lines, dropped, kept) of rows (id, text, order), the order naming the first document."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    lines = [(r[1] or "").split("\n") for r in rows]
    count = Counter(k for x in lines for k in {key(y) for y in x} if len(k) >= max(1, chars))
    repeated = {k for k, n in count.items() if n >= least}
    firsts = {k: min(r[2] for r, x in zip(rows, lines) if k in map(key, x)) for k in repeated} if keep_first else {}
    out = []
    for r, x in zip(rows, lines):
        held, kept = set(), []
        for y in x:
            k = key(y)
            if k not in repeated or (firsts.get(k) == r[2] and k not in held):
                kept.append(y)
            held.add(k)
        out.append((r[0], len(x), len(x) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("broadcast", [1000, 0])
@pytest.mark.parametrize("keep_first", [False, True])
def test_equals_brute_force(spark, broadcast, keep_first):
    rng = np.random.default_rng(11)
    common = ["Share this", "  ÀÉ Über\t", "x", "", "   ", "\r", "Copyright 2024 — all rights", "a b", "A B "]
    texts = []
    for _ in range(150):
        lines = [common[int(rng.integers(len(common)))] if rng.random() < 0.4 else f"line {int(rng.integers(400))} of text " for _ in range(int(rng.integers(0, 12)))]
        texts.append("\n".join(lines))
    texts += [None, "", "\n", "\n\n", "Share this\n" * 30000, "no end " * 30000, "z\n" + texts[0]]
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, "clash", 1.5) for r in rows], "doc_id long, text string, n_lines string, digest double").repartition(5)
    for least in (2, 10):
        found = dedup_lines(frame, least_documents=least, keep_first=keep_first, broadcast_keys=broadcast)
        assert found.columns == ["doc_id", "text", "digest", "n_lines", "n_dropped", "kept_text"]
        got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect())
        assert got == brute([(i, t, i) for i, t in rows], least, keep_first=keep_first)


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_null_and_repeated_ids(spark, broadcast):
    rows = [(None, "a\nb"), (None, "a\nc"), (3, "a\nd"), (3, "a\nd"), (4, None), (5, "A \nb\nb")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text, r.kept_text) for r in dedup_lines(frame, least_documents=2, broadcast_keys=broadcast).collect())
    assert got == Counter({(None, "a\nb", ""): 1, (None, "a\nc", "c"): 1, (3, "a\nd", ""): 2, (4, None, ""): 1, (5, "A \nb\nb", ""): 1})
    kept = [r.kept_text for r in dedup_lines(frame, least_documents=3, keep_first=True, broadcast_keys=broadcast).where("doc_id is null").collect()]
    assert sum(x.startswith("a\n") for x in kept) == 1 and len(kept) == 2


def test_short_keys_stay(spark):
    frame = spark.createDataFrame([(i, "é\nlonger line") for i in range(4)], "doc_id long, text string")
    assert {r.kept_text for r in dedup_lines(frame, least_documents=4, least_chars=2).collect()} == {"é"}
    with pytest.raises(ValueError):
        dedup_lines(frame, least_documents=1)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_full_filter_still_gives_exact_results(spark, monkeypatch):
    """Tasks that send after every slice, and a filter in which nearly every line is suspected."""
    monkeypatch.setattr(line_dedup, "DENSITY", 2.0)
    rows = [(i, f"only {i}\nboth\n{i % 7} of seven") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(frame, least_documents=9).collect())
    assert got == brute([(i, t, i) for i, t in rows], 9)


def test_the_filter_misses_no_repeat_and_suspects_few_others(spark):
    rng = np.random.default_rng(4)
    unique, shared = rng.integers(0, 2**64, 200_000, dtype=np.uint64), rng.integers(0, 2**64, 2_000, dtype=np.uint64)
    parts = [line_dedup._part([np.append(x, shared)]) for x in np.array_split(unique, 20)]
    merged = [next(line_dedup._merged_segment((b["segment"][0],), [p.slice(s, 1) for p in parts])) for s in range(line_dedup.SEGMENTS) for b in [parts[0].slice(s, 1)]]
    import pyarrow as pa

    seen = line_dedup.TwiceSeen.of(pa.Table.from_batches(merged))
    assert seen.suspects(shared).all() and seen.suspects(unique).mean() < 0.01
    assert len(seen.bits) < 1 << 20
