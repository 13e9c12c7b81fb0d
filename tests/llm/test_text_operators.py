"""Substring dedup, decontamination, SimHash and LM scoring against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from loomdex.llm import lm_score, simhash, tokens
from loomdex.llm.decontam import decontaminate
from loomdex.llm.fm_index import FMIndex
from loomdex.llm.graph import components
from loomdex.llm.lm_score import score
from loomdex.llm.simhash import near_dedup, near_duplicate_groups, simhash_groups
from loomdex.llm.substring import dedup_substrings
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(n=60, seed=3):
    """Texts with copies, shared passages, odd spaces, nulls, empties and a long one."""
    rng = np.random.default_rng(seed)
    vocabulary = ["Wörd", "the", "THE", "a", "naïve", "x1", "of", "über", "end.", "q r"] + [f"w{i}" for i in range(400)]
    draw = lambda k: [vocabulary[i] for i in rng.integers(0, len(vocabulary), k)]
    passages = [draw(20), draw(14), draw(13), draw(12)]
    texts = [None, "", " \t\n", "one", "the The", " ".join(draw(3000))]
    while len(texts) < n:
        words = draw(int(rng.integers(1, 90)))
        for p in rng.integers(0, len(passages), rng.integers(0, 3)):
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = passages[p]
        texts.append([" ", "\n", "  "][len(texts) % 3].join(words))
        if len(texts) % 5 == 0:
            texts.append(texts[-1])
        if len(texts) % 7 == 0 and len(words) > 30:
            texts.append(" ".join(words[:12] + ["changed"] + words[13:]))
    order = rng.permutation(len(texts))
    return [(int(order[i]), t, "clash") for i, t in enumerate(texts)], passages


@pytest.fixture(scope="module")
def corpus(spark):
    rows, passages = documents()
    rows.append(rows[10])
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3), passages


def test_words_agree_with_the_pattern():
    texts = ["a b", None, "", "x", "y ", " z\n é", "AbC9-é_f", "tail"]
    column = pa.array(texts)
    for letters, table, pattern, change in ((tokens.NOT_SPACE, tokens.SAME, WORD, str), (tokens.ALNUM, tokens.LOWER, ALNUM, lower)):
        for limit in (1, 4, 1 << 20):
            got = []
            for _, n, data, offsets in tokens.text_slices(column, limit):
                w = tokens.split_words(data, offsets, letters, table)
                own = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]
                got += [own[w.first[i] : w.first[i + 1]] for i in range(n)]
            assert got == [pattern.findall(change(t or "")) for t in texts]


def test_word_hashes_are_by_content():
    data = "ab ba ab é ba aab".encode()
    w = tokens.split_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    h = w.hashes()
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 4


def brute_substrings(rows, window=13):
    first = {}
    for doc, text, _ in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), doc)
    out = []
    for doc, text, _ in rows:
        words = WORD.findall(text or "")
        hit = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < doc:
                hit.update(range(i, i + window))
        out.append((doc, len(words), len(hit), " ".join(w for i, w in enumerate(words) if i not in hit)))
    return sorted(out)


def test_substrings_equal_brute_force(corpus):
    rows, frame, _ = corpus
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(frame).collect())
    assert got == brute_substrings(rows)
    assert sum(r[2] for r in got) > 100


@pytest.mark.parametrize("recent", [1 << 20, 1])
def test_factors_rebuild_what_is_removed(spark, corpus, monkeypatch, recent):
    """Each factor is a passage of an earlier document, as long as both go on alike in the block; together they cover the removed words."""
    from loomdex.llm import substring

    monkeypatch.setattr(substring, "RECENT", recent)
    rng = np.random.default_rng(9)
    source = [f"w{i}" for i in rng.integers(0, 300, 400)]
    rows = [(i, " ".join([*(f"x{j}" for j in rng.integers(0, 5000, 6)), *source[int(a) : int(a) + int(n)], *source[int(b) : int(b) + 30], "end"]), "") for i, (a, b, n) in enumerate(rng.integers(0, 350, (60, 3)) % [350, 350, 60])]
    rows += [(100 + i, f"{t} and more", x) for i, (_, t, x) in enumerate(rows[:10])] + [(3, rows[3][1], "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(3)
    found = dedup_substrings(frame, factors=True)
    assert found.columns == ["doc_id", "text", "x", "n_words", "n_removed", "kept_text", "factors"]
    got = found.collect()
    words = {d: WORD.findall(t) for d, t, _ in rows}
    seen = 0
    for r in got:
        own, covered = words[r.doc_id], set()
        for f in r.factors:
            assert f.source < r.doc_id and f["size"] >= 13
            assert own[f.start : f.start + f["size"]] == words[f.source][f["at"] : f["at"] + f["size"]]
            covered.update(range(f.start, f.start + f["size"]))
            seen += f["size"] > 13
        assert len(covered) == r.n_removed and r.kept_text == " ".join(w for i, w in enumerate(own) if i not in covered)
    assert seen > 20 and sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_substrings(rows)


def test_factors_are_taken_greedily():
    from loomdex.llm.substring import _common, _greedy

    words = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 7, 1, 2, 3, 4, 5, 9], np.uint32)
    p, r = np.array([6, 7, 11, 12, 13]), np.array([0, 1, 0, 1, 2])
    assert _common(words, p, r, 2, np.array([5, 4, 6, 5, 4])).tolist() == [4, 3, 6, 5, 4]
    # with windows of two words: one factor of each phrase, as the others lie inside
    assert _greedy(np.array([0, 0, 1, 1, 1]), p, np.array([4, 3, 6, 5, 4]), 2).tolist() == [0, 2]
    assert _greedy(np.array([0, 0, 0]), np.array([0, 3, 4]), np.array([4, 4, 4]), 2).tolist() == [0, 1]
    assert _greedy(*(np.zeros(0, np.int64),) * 3, 2).tolist() == []


def test_substrings_of_passages_in_every_slice(spark):
    # texts of half a slice in one task: what it remembers of other slices settles most of the copies
    rng = np.random.default_rng(12)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 90_000, n)]
    passage, other = words(60), words(25)
    rows = []
    for i in rng.permutation(24).tolist():
        text = words(10) + passage[: 60 - i % 7] + words(60_000 if i % 2 else 20)
        rows.append((i, " ".join(text + other * (i % 3 == 0)), ""))
    rows += [rows[4], (None, rows[7][1], ""), (None, None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_removed string").coalesce(1)
    got = sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(frame).collect())
    assert got == brute_substrings([(-(2**63) if d is None else d, t, x) for d, t, x in rows])


def test_substrings_of_a_very_long_text(spark):
    rng = np.random.default_rng(13)
    long = [f"w{i}" for i in rng.integers(0, 50_000, 400_000)]
    rows = [(1, " ".join(long[200_000:200_100]), ""), (2, " ".join(long), ""), (3, " ".join(long[:150_000]), "")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect())
    assert got == [(1, 100, 0), (2, 400_000, 100), (3, 150_000, 150_000)]


def test_substrings_of_repeats_inside_a_document_stay(spark):
    text = " ".join(["again"] * 40)
    rows = [(5, text, ""), (7, text, ""), (7, text + " more", "")]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect())
    assert got == brute_substrings(rows)


def test_substrings_of_an_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(0)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (1, 50, 7, 200)])
    index = FMIndex(text, 3, sample=4)
    for width in (1, 3, 5):
        phrases = rng.integers(1, 4, (30, width))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            expected = [i for i in range(len(text) - width + 1) if (text[i : i + width] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


@pytest.mark.parametrize("block", [250_000, 5])
def test_decontamination_equals_brute_force(spark, corpus, monkeypatch, block):
    monkeypatch.setattr("loomdex.llm.decontam.BLOCK_PHRASES", block)
    monkeypatch.setattr("loomdex.llm.decontam.BLOCKS_AT_ONCE", 2)
    rows, frame, passages = corpus
    items = [(1, " ".join(passages[0])), (2, " ".join(passages[1]).upper()), (10, "The"), (11, None), (12, "... !"), (13, " ".join(passages[0][:16])), (None, "w1 w2")]
    got = {}
    for r in decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, list(r["items"]), r.contaminated, sum(s.stop - s.start for s in r.spans)))
    phrases = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(lower(text))
        if words:
            n = min(13, len(words))
            for i in range(len(words) - n + 1):
                phrases[tuple(words[i : i + n])].add(str(item) if item is not None else "")
    for doc, text, _ in rows:
        words, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in phrases:
                    hit.update(range(i, i + n))
                    found |= phrases[tuple(words[i : i + n])]
        expected = (len(words), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words), len(hit))
        assert expected in got[doc]
    assert sum(map(len, got.values())) == len(rows)


def test_decontamination_without_items_or_documents(spark, corpus):
    _, frame, _ = corpus
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, r.contaminated) for r in decontaminate(frame, empty).collect()} == {(0, False)}
    assert decontaminate(frame.limit(0), empty).collect() == []


def brute_fingerprint(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Sets:
    def __init__(self, names):
        self.up = {n: n for n in names}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def test_simhash_equals_brute_force(corpus):
    rows, frame, _ = corpus
    prints = {doc: brute_fingerprint(text) for doc, text, _ in rows}
    sets = Sets(prints)
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                sets.join(a, b)
    got = [(r.id, r.print & (2**64 - 1), r.component) for r in simhash_groups(frame).collect()]
    assert sorted(got) == sorted((doc, prints[doc], sets.find(doc)) for doc, _, _ in rows)


def test_simhash_links_form_chains(spark):
    from loomdex.llm.simhash import link

    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(0, 2**63, 40)]
    for _ in range(150):
        x = prints[int(rng.integers(0, len(prints)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 4))):
            x ^= 1 << int(b)
        prints.append(x)
    prints = sorted(set(prints))
    sets = Sets(range(len(prints)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2:
                sets.join(i, j)
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    got = {r.node: r.component for r in link(spark.createDataFrame(rows, "node long, print long")).collect()}
    assert all(got.get(i, i) == sets.find(i) for i in range(len(prints)))


@pytest.mark.parametrize("spread", [32, 8])
def test_a_large_key_is_split_and_loses_no_link(spark, monkeypatch, spread):
    """Prints that all agree in two quarters; of the rest they differ in many bits, or in so few that finer keys are large too."""
    from loomdex.llm import simhash

    monkeypatch.setattr(simhash, "HOT_ROWS", 40)
    rng = np.random.default_rng(spread)
    base = 0x1234_5678_0000_0000
    prints = {base | (int(rng.integers(0, 2**32)) & (2**spread - 1 if spread < 32 else 2**32 - 1)) << (0 if spread == 32 else 3) for _ in range(600)}
    prints |= {p ^ (1 << int(rng.integers(0, 32))) ^ (1 << int(rng.integers(0, 32))) for p in sorted(prints)[:200]}
    prints |= {int(x) for x in rng.integers(0, 2**63, 100)}
    prints = sorted(prints)
    sets = Sets(range(len(prints)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2:
                sets.join(i, j)
    frame = spark.createDataFrame(list(enumerate(prints)), "node long, print long").repartition(3)
    got = {r.node: r.component for r in simhash.link(frame).collect()}
    assert all(got.get(i, i) == sets.find(i) for i in range(len(prints)))
    keyed = frame.select("node", "print", F.inline(simhash._quarter_keys(F.col("print"))))
    assert keyed.groupBy("key").count().agg(F.max("count")).first()[0] > 40
    # a block and another one at most
    assert simhash._comparable(keyed).groupBy("key").count().agg(F.max("count")).first()[0] <= 4 * 40


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def jaccard_sets(rows):
    sets = Sets({r[0] for r in rows})
    shingles = {}
    for doc, text, _ in rows:
        words = WORD.findall(lower(text))
        shingles[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}
    for a in shingles:
        for b in shingles:
            common = len(shingles[a] & shingles[b])
            if common >= 0.8 * (len(shingles[a]) + len(shingles[b]) - common):
                sets.join(a, b)
    return sets


def test_near_duplicates_equal_brute_force(spark, corpus):
    rows, frame, _ = corpus
    sets = jaccard_sets(rows)
    assert {(r.id, r.component) for r in near_duplicate_groups(frame).collect()} == {(r[0], sets.find(r[0])) for r in rows}
    kept = near_dedup(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({sets.find(r[0]) for r in rows})


def test_near_duplicates_in_a_large_group(spark):
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 4))):
            words[int(at)] = f"c{i}"
        rows.append((i, " ".join(words), ""))
    sets = jaccard_sets(rows)
    got = {r.id: r.component for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()}
    assert got == {i: sets.find(i) for i in range(150)}


def test_near_copies_among_many_texts_of_one_template(spark, monkeypatch):
    # a repeated passage draws fingerprints of unlike texts to those of the copies, away from those of the copied
    base = [f"b{i}" for i in range(150)]
    again = base[50:60] * 8
    rows = [(i, " ".join(base + [f"d{i}x{k}" for k in range(22)] + again * (i < 360)), "") for i in range(400)]
    rows += [(1000 + i, " ".join([*rows[360 + i][1].split(), *again]).replace(f"b{3 * i} ", "e "), "") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, x string")
    sets = jaccard_sets(rows)
    assert sum(sets.find(r[0]) != r[0] for r in rows) >= 30
    for docs in (simhash.BLOCK_DOCS, 30):
        monkeypatch.setattr(simhash, "BLOCK_DOCS", docs)
        assert {r.id: r.component for r in near_duplicate_groups(frame).collect()} == {r[0]: sets.find(r[0]) for r in rows}


def test_near_copies_that_differ_in_how_often_a_line_repeats(spark):
    rows = []
    for i in range(40):
        words = [f"t{i}x{k}" for k in range(60)]
        rows += [(2 * i, " ".join(words), ""), (2 * i + 1, " ".join(words + words[20:30] * 40), "")]
    rows += [(100, "a b c d e f g h", ""), (101, "a b c d e f g h i", "")]
    sets = jaccard_sets(rows)
    assert all(sets.find(2 * i + 1) == 2 * i for i in range(40)) and sets.find(101) == 100
    got = {r.id: r.component for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()}
    assert got == {r[0]: sets.find(r[0]) for r in rows}


def test_near_dedup_of_an_empty_table(spark):
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("slice_bytes", [lm_score.SLICE_BYTES, 3000])
def test_lm_scores_equal_brute_force(spark, corpus, monkeypatch, slice_bytes):
    monkeypatch.setattr(lm_score, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", slice_bytes)
    rows, _, _ = corpus
    rows = [(d, t) for d, t, _ in rows]
    frame = spark.createDataFrame(rows + [(None, "w1 w1 w2")], "doc_id long, text string").repartition(3)
    labels = [(d, int(d % 3 == 0), 0) for d, _ in rows] + [(10**6, 1, 0), (None, 1, 0)]
    good = {d for d, q, _ in labels if q}
    sequence = [(d, ["<s>", *WORD.findall(lower(t)), "</s>"]) for d, t in rows]
    vocabulary = {w for _, s in sequence for w in s[1:]}

    def model(docs):
        one = Counter(w for s in docs for w in s)
        two = Counter(p for s in docs for p in zip(s, s[1:]))
        total = sum(n for w, n in one.items() if w != "<s>") + len(vocabulary)
        prior = lm_score.PRIOR
        return lambda u, w: -math.log((two[u, w] + prior * (one[w] + 1) / total) / (one[u] + prior))

    target, background = model([s for d, s in sequence if d in good]), model([s for _, s in sequence])
    expected = []
    for d, s in sequence:
        own = list(zip(s, s[1:]))
        expected.append((d, len(own), *(sum(m(*p) for p in own) / len(own) for m in (target, background))))
    scored = score(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = [(r.id, r.n_tokens, r.target_loss, r.background_loss) for r in scored.collect()]
    assert len(got) == len(expected)
    for g, e in zip(sorted(got), sorted(expected)):
        assert g[:2] == e[:2] and math.isclose(g[2], e[2], rel_tol=1e-9) and math.isclose(g[3], e[3], rel_tol=1e-9)


def test_lm_scores_of_slices_with_equal_content(spark, monkeypatch):
    # two files of the same rows are two slices of one name
    rows = [(i, f"a b c w{i}") for i in range(6)]
    twice = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in score(twice.union(twice), labels).collect())
    again = sorted(tuple(r) for r in score(spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(5), labels).collect())
    assert len(got) == 12 and np.allclose(np.array(got), np.array(again), rtol=1e-12)


def test_lm_scores_know_texts_that_occur_twice(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 30)], "doc_id long, quality int, toxic int")
    got = {r.id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert min(got[i] for i in range(10)) > max(got[i] for i in range(10, 40))


def test_lm_scores_prefer_what_is_like_the_target(spark):
    rows = [(i, " ".join(["good", "clean", "prose"] * 10 if i % 2 else ["bad", "noisy", "spam"] * 10)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = {r.id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert max(got[i] for i in got if i % 2) < min(got[i] for i in got if not i % 2)


def test_lm_scores_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.n_tokens for r in score(docs, labels).collect()] == [1]
    assert score(docs.limit(0), labels).collect() == []


def test_scores_and_groups_of_rows_without_an_id(spark):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, None), (2, None), (3, "a b c d e f g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r.id for r in score(frame, labels).collect()) == [1, 2, 2, 3]
    groups = simhash_groups(frame).collect()
    # a row without an id has a fingerprint, and the component of those it equals
    assert len(groups) == len(rows) and {r.component for r in groups if r.print == 0} == {2} and {r.component for r in groups if r.id is None} == {1, 2}
    kept = near_dedup(frame).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept) == [-1, -1, 1, 2, 3]


def test_near_duplicates_of_null_empty_and_very_long_texts(spark):
    rng = np.random.default_rng(15)
    long = [f"w{i}" for i in rng.integers(0, 80_000, 300_000)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, " ".join(long)), (5, " ".join(long[:280_000])), (6, " ".join(long[:200_000])), (7, "One Two"), (8, "one two"), (9, "one two three")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string")
    assert {(r.id, r.component) for r in near_duplicate_groups(frame).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (9, 9)}
    assert near_dedup(frame).columns == ["doc_id", "text", "component"]


def test_lm_scores_of_a_very_long_text(spark):
    rng = np.random.default_rng(16)
    rows = [(1, " ".join(f"w{i}" for i in rng.integers(0, 5000, 300_000))), (2, "w1 w2"), (3, "")]
    got = {r.id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")).collect()}
    assert got[1].n_tokens == 300_001 and got[2].n_tokens == 3 and got[2].score < got[1].score and got[2].target_loss < got[2].background_loss


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_every_good_label_is_a_target(spark, monkeypatch, broadcast):
    """With all documents good both models are one, however many there are and however labels meet them."""
    from loomdex.llm import lm_score

    monkeypatch.setattr(lm_score, "BROADCAST_LABELS", broadcast)
    docs = spark.range(52_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), F.col("id") % 97, F.lit(" v"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    rows = score(docs, labels)
    assert rows.where("abs(score) > 1e-12").count() == 0 and rows.count() == 52_000
