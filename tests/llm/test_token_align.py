"""Token alignment against a brute-force version with the tokenizers' own libraries."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
from loomdex.llm import token_align
from loomdex.llm.queries import queries
from loomdex.llm.token_align import TOKENIZERS, Aligned, align_tokens, shared_groups, tokenizer_files


def brute(rows):
    """The query's rows of (doc_id, text)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode()

    groups, holding = [], defaultdict(set)
    for doc, text in rows:
        a, b = [], []
        if text:
            a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, piece(i)) for i in two.encode(text)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == b" " + text.encode():
                a, b = [], []
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        own_groups = [([], []) for _ in cuts]
        for side, (tokens, e) in enumerate(zip((a, b), ends)):
            for (i, _), end in zip(tokens, e):
                own_groups[int(np.searchsorted(cuts, end))][side].append(i)
        groups.append((doc, len(a), len(b), own_groups))
        for x, y in own_groups:
            for i in x:
                for j in y:
                    holding[i, j].add(len(groups))
    count = {pair: len(docs) for pair, docs in holding.items()}
    highest = Counter()
    for (i, _), n in count.items():
        highest[i] = max(highest[i], n)
    out = []
    for doc, n_a, n_b, own_groups in groups:
        links = [(i, j) for x, y in own_groups for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own_groups)
        out.append((doc, n_a, n_b, len(own_groups), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  \n\t ", "<|endoftext|> </s> <unk> <s>", "▁", "a▁b", "naïve café — “quotes” …", "日本語のテキスト、漢字かな交じり文。", "👩‍👩‍👧‍👦🏳️‍🌈 emoji", "\x00\x01 control", "a" * 5000, "ab " * 3000, " " * 300 + "x", "12345678901234567890", "Привет, мир! नमस्ते สวัสดี",
    "same text", "same text", "﻿bom ​ zero width", "I'll they've don't", "\r\n\r\n", "xyzzy" * 300 + "日" * 500,
]


def test_odd_texts_equal_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "again 3"), (3, "again 3")]
    frame = spark.createDataFrame([(*r, "clash", 2.0) for r in rows], "doc_id long, text string, n_best string, pair double").repartition(3)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["op12_token_align"](spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_query_equals_brute_force(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries()["op12_token_align"](spark, tiny).collect()), key=repr) == brute(rows)


def test_groups_spell_the_text(spark):
    rows = [(i, t) for i, t in enumerate(ODD) if t]
    sources = tokenizer_files(spark)
    one, two = token_align.ByteBPE(sources.value[0]), token_align.PieceBPE(sources.value[1])
    scored = align_tokens(spark.createDataFrame(rows, "doc_id long, text string"), sources)
    assert scored.columns[:2] == ["doc_id", "text"]
    for r in scored.collect():
        a = b = 0
        for x, y in zip(r.a_sizes, r.b_sizes, strict=True):
            assert b"".join(one.pieces[i] for i in r.a_ids[a : a + x]) == b"".join(two.pieces[i] for i in r.b_ids[b : b + y])
            a, b = a + x, b + y
        assert a == len(r.a_ids) and b == len(r.b_ids)


def test_groups_are_all_shared_cuts():
    rng = np.random.default_rng(12)
    for share in (0.02, 0.3, 0.9):
        ends = [[], []]
        firsts = [[0], [0]]
        base = 0
        for _ in range(30):
            size = int(rng.integers(0, 400))
            for side in (0, 1):
                inner = np.flatnonzero(rng.random(max(0, size - 1)) < share) + 1
                if size:
                    ends[side].append(base + np.append(inner, size))
                firsts[side].append(firsts[side][-1] + (len(inner) + 1 if size else 0))
            base += size
        a, b = (np.concatenate(e) for e in ends)
        a_end, b_end = shared_groups(a, b, *(np.array(f) for f in firsts))
        assert np.array_equal(a[a_end - 1], np.intersect1d(a, b)) and np.array_equal(b[b_end - 1], np.intersect1d(a, b))


def test_links_are_listed_in_parts(monkeypatch, spark):
    frame = spark.createDataFrame([(1, "日本語" * 200), (2, "plain words")], "doc_id long, text string")
    sources = tokenizer_files(spark)
    rows = token_align._align(frame, sources, "text", False).where("tokens is not null").collect()
    whole = Aligned.of([bytes(r.tokens) for r in rows], [r["size"] for r in rows])
    parts = list(token_align._links(whole))
    monkeypatch.setattr(token_align, "PAIRS", 3)
    small = list(token_align._links(whole))
    total = lambda found: Counter({(int(p), int(r)): int(sum(t[(ps == p) & (rs == r)].sum() for ps, rs, t in found)) for ps_, rs_, _ in found for p, r in zip(ps_, rs_)})
    assert len(small) > len(parts) and total(small) == total(parts)


def test_empty_table(spark):
    sources = tokenizer_files(spark)
    assert align_tokens(spark.createDataFrame([], "doc_id long, text string"), sources, texts=True).collect() == []


def test_packed_tokens_come_back():
    sizes, first = np.array([1, 254, 255, 256, 3, 600, 510]), np.array([0, 2, 2, 5, 7])
    one = Aligned(np.array([5, 50256]), np.array([31999]), sizes, sizes[::-1], np.array([0, 0, 1, 1, 2]), np.array([0, 1, 1, 1, 1]), first)
    none = Aligned(*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(2, np.int64) for _ in range(3)))
    back = Aligned.of(*zip(*(x.packed() for x in (none, one, none))))
    assert back.a.tolist() == [5, 50256] and back.b.tolist() == [31999] and back.a_sizes.tolist() == sizes.tolist() and back.b_sizes.tolist() == sizes[::-1].tolist()
    assert back.first.tolist() == [0, *first.tolist(), 7] and back.a_first.tolist() == [0, 0, 0, 1, 1, 2, 2]
