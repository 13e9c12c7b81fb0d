"""Each stage of the pipeline, on what the stage before it kept, against a plain version of the same rule."""

import corpus_pipeline
import pytest
from loomdex.llm.langid import UNKNOWN, train
from loomdex.llm.mixing import MAX_EPOCHS
from test_other_operators import brute_languages, brute_targets
from test_text_operators import ALNUM, brute_substrings, jaccard_sets, lower


def contaminated(text, items):
    """Whether at least a twentieth of a text's words are inside benchmark windows."""
    words, hit = ALNUM.findall(lower(text)), set()
    for item in items:
        own = ALNUM.findall(lower(item))
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1 if own else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


@pytest.fixture(scope="module")
def stages(spark, tiny):
    """Rows that each stage got and gave."""
    frame, out = spark.read.parquet(f"{tiny}/documents.parquet"), {}
    # junk in no language, and rows without words or text
    odd = [(10**6 + i, t, None, "src1", 1) for i, t in enumerate(["zq xj vvk " * 60, "", None, "qxz jkv wqp zzx " * 50])]
    frame = frame.union(spark.createDataFrame(odd, frame.schema))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, frame, tiny)
        rows = after.collect()
        out[name] = (frame.collect(), rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            frame = spark.createDataFrame(rows, after.schema)
    return out


def test_language(spark, tiny, stages):
    before, after = stages["language_id"]
    model = train(spark.createDataFrame(before, spark.read.parquet(f"{tiny}/documents.parquet").schema))
    judged = brute_languages([(r.doc_id, r.text, r.source, None, None) for r in before], model)
    gone = {r.doc_id for r, (language, confidence, _) in zip(before, judged) if language == UNKNOWN and confidence >= corpus_pipeline.REJECT_CONFIDENCE}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - gone and set(after) <= set(before)
    assert 10**6 in gone and len(after) > 0.9 * len(before)


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    sets = jaccard_sets([(r.doc_id, r.text, None) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({sets.find(r.doc_id) for r in before})
    assert len(after) < len(before) and set(after) <= set(before)


def test_repeated_passages(stages):
    before, after = stages["repeated_passages"]
    kept = {r[0]: r for r in brute_substrings([(r.doc_id, r.text, None) for r in before])}
    old = {r.doc_id: r for r in before}
    assert len(after) == len(before) and sum(n for _, _, n, _ in kept.values()) > 0
    for r in after:
        _, _, removed, text = kept[r.doc_id]
        assert r.text == (text if removed else old[r.doc_id].text) and r.n_chars == (len(text) if removed else old[r.doc_id].n_chars)


def test_benchmark_passages(spark, tiny, stages):
    before, after = stages["benchmark_passages"]
    items = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not contaminated(r.text, items))
    assert set(after) <= set(before)


def test_mixture(stages):
    before, after = stages["mixture"]
    size = {r.doc_id: len((r.text or "").encode().split()) for r in before}
    sizes, taken = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + size[r.doc_id]
    for r in after:
        assert r.size == size[r.doc_id] and r.taken <= MAX_EPOCHS * r.size and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    target = brute_targets(sizes)
    assert len(after) == len(before) and all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_fingerprint_groups_are_candidates(spark):
    """Texts of one fingerprint that no band holds both of are compared too: one passage repeated decides the fingerprint, different ends the sets."""
    import random

    from loomdex.llm.simhash import near_duplicate_groups, simhash_groups

    draw = random.Random(5)
    rows = [(i, "x y z " * 400 + " ".join(f"w{draw.randrange(10**9)}" for _ in range(12))) for i in range(4)]
    frame = spark.createDataFrame([*rows, (9, "quite another text of its own words")], "doc_id long, text string")
    assert len({r.component for r in simhash_groups(frame).where("id < 9").collect()}) == 1
    groups = {r.id: r.component for r in near_duplicate_groups(frame, similarity=0.05).collect()}
    assert groups == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    assert {r.id: r.component for r in near_duplicate_groups(frame).collect()} == {i: i for i in (0, 1, 2, 3, 9)}
