"""Sources, blocks, chunks, vectors and sinks on hand-made inputs."""

import re

import numpy as np
import pytest
from loomdex.operators import chunking as C
from loomdex.operators import evaluation as E
from loomdex.operators import policy as P
from loomdex.operators import retrieval as R
from loomdex.operators import vectors as V
from loomdex.operators.index import build_index, count_words, word_totals
from loomdex.sources import blocks as B
from loomdex.sources import files as X
from pyspark.sql import functions as F


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def blocks(frame):
    return [(r.kind, r.level, r.text) for r in frame.orderBy("id", "pos").collect()]


def test_markdown_blocks(spark):
    text = "# One #\nfirst line\nsecond line\n\n| a | b |\n|---|---|\n| 1 | 2 |\n```py\n# not a heading\n\nx = 1\n```\n### Three\n```\nopen\nfence"
    assert blocks(B.markdown_blocks(docs(spark, text), "id", "text")) == [
        ("heading", 1, "One"), ("paragraph", None, "first line second line"), ("row", None, "| a | b |"), ("row", None, "| 1 | 2 |"), ("pre", None, "# not a heading\n\nx = 1"), ("heading", 3, "Three"), ("pre", None, "open\nfence"),
    ]


def test_html_blocks(spark):
    html = "<!-- c --><h2>T &amp; U</h2><p>a <b>b</b><br>c<table><tr><td>x</td><td>y</td></tr></table><script>no</script>"
    assert blocks(B.html_blocks(docs(spark, html), "id", "text")) == [("heading", 2, "T & U"), ("paragraph", None, "a b"), ("paragraph", None, "c"), ("paragraph", None, "x y")]


def test_code_blocks(spark):
    text = "import x\n\ndef f():\n    return 1\nclass A:\n    pass\n"
    assert blocks(B.code_blocks(docs(spark, text), "id", "text")) == [("pre", None, "import x"), ("heading", 2, "def f():"), ("pre", None, "def f():\n    return 1"), ("heading", 2, "class A:"), ("pre", None, "class A:\n    pass")]


def test_page_text(spark):
    text = "2.1 Scope of Work\nThis para-\ngraph goes on and on until its end is reached here\nand stops.\nNext one starts.\nGENERAL TERMS\nMore text"
    assert blocks(B.page_text_blocks(docs(spark, text), "id", "text")) == [
        ("heading", 2, "2.1 Scope of Work"), ("paragraph", None, "This paragraph goes on and on until its end is reached here and stops."), ("paragraph", None, "Next one starts."), ("heading", 1, "GENERAL TERMS"), ("paragraph", None, "More text"),
    ]


def test_markdown_tables_and_sections(spark):
    text = "# Plan\nintro\n- one\n2. two\n> note\n| name | cost |\n|---|---|\n| a | $1,200 |\n| b | n/a |\nafter\n## Part\nend"
    table = B.markdown_tables(docs(spark, text), "id", "text").collect()[0]
    assert table.header == ["name", "cost"] and [[(c.text, c.number) for c in r] for r in table.rows] == [[("a", None), ("$1,200", 1200.0)], [("b", None), ("n/a", None)]]
    got = [(r.section, r.heading, r.level, r.paragraphs, r.bullets, r.callout, r.table and (r.table.headers, r.table.rows)) for r in B.markdown_sections(docs(spark, text), "id", "text").orderBy("section").collect()]
    assert got == [(1, "Plan", 1, ["intro", "after"], ["one", "two"], "note", (["name", "cost"], [["a", "$1,200"], ["b", "n/a"]])), (2, "Part", 2, ["end"], [], None, None)]


def walked_sections(text):
    """(heading, subheading, paragraphs, bullets, callout, table) of each section, line by line."""
    sections, table, now = [], [], None

    def close_table():
        rules = [i for i, c in enumerate(table) if all(re.fullmatch(":?-+:?", x) for x in c)]
        rows = [c for i, c in enumerate(table) if rules and i > rules[0] and i not in rules]
        if rules and rules[0] > 0 and rows and now is not None:
            now[5] = (table[rules[0] - 1], rows)
        table.clear()

    for line in [x.strip() for x in re.sub(r"(?s)```.*?```", "", text).strip().split("\n")] + [""]:
        if len(line) > 1 and line[0] == line[-1] == "|":
            table.append([c.strip() for c in line[1:-1].split("|")])
            continue
        close_table()
        if not line:
            continue
        strong = re.fullmatch(r"\*\*([0-9]+\.?[^*]+|[A-Z][^*]{2,50}?):?\*\*", line)
        opening = re.fullmatch(r"#{1,2}\s+(\S.*)", line) or strong
        if opening or now is None:
            now = [opening[1].strip() if opening else "Overview", None, [], [], None, None]
            sections.append(now)
        if opening:
            continue
        if m := re.fullmatch(r"###\s+(\S.*)", line):
            now[1] = m[1]
        elif re.match(r"[-*•]\s|[0-9]+\.\s", line):
            now[3].append(re.sub(r"^[-*•0-9.]+\s*", "", line))
        elif line[0] == ">":
            now[4] = re.sub(r"^>\s*", "", line)
        else:
            now[2].append(line)
    return [tuple(x) for x in sections]


def test_sections_equal_a_walk_over_lines(spark):
    rng = np.random.default_rng(21)
    lines = ["# One", "## Two words", "**3. Third**", "**Strong:**", "**not strong** here", "### Sub", "#### deep", "#tag", "plain text", "- item", "* item", "• item", "12. twelfth", "1.5 no item", "> said", ">", "| a | b |", "|---|:-:|", "| 1 | 2 |", "| open", "|", "", "   ", "```", "x = 1", "  ## indented "]
    texts = ["\n".join(lines[int(i)] for i in rng.integers(0, len(lines), int(rng.integers(0, 25)))) for _ in range(300)] + ["", "\n\n", "| a |\n|---|\n| 1 |"]
    found = {}
    for r in B.markdown_sections(docs(spark, *texts, None), "id", "text").orderBy("id", "section").collect():
        found.setdefault(r.id, []).append((r.heading, r.subheading, r.paragraphs, r.bullets, r.callout, r.table and (r.table.headers, r.table.rows)))
    for i, text in enumerate(texts):
        assert found.get(i, []) == walked_sections(text), text
    assert len(texts) not in found


def test_titles_and_subtitles(spark):
    texts = ["# T\n> sub\nrest\n## A\nx", "# T\n\npara\n## A", "intro\n# T\nmore", "no heading", "", "\n".join(["line"] * 12) + "\n# late", "# Only\ntext"]
    got = [(r.title, r.subtitle, [s.heading for s in r.sections]) for r in B.markdown_documents(docs(spark, *texts, None), "id", "text").orderBy("id").collect()]
    assert got == [("T", "sub", ["A"]), ("T", "para", ["A"]), ("T", None, ["Overview", "T"]), ("Overview", None, ["Overview"]), (None, None, []), ("Overview", None, ["Overview", "late"]), ("Only", "text", ["Only"]), (None, None, [])]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\n"Ann","says ""hi"", ok"\n,\nBob,\n')
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n")
    assert sorted(r.fact for r in B.read_facts(spark, str(tmp_path / "a.csv")).collect()) == ['name: Ann · note: says "hi", ok', "name: Bob"]
    assert [r.fact for r in B.read_facts(spark, str(tmp_path / "b.tsv")).collect()] == ["x: 1 · y: 2"]


def test_scan_and_mail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.MD").write_text("# hi")
    (tmp_path / "in" / "1.eml").write_bytes(b"From: \"Ann B\" <a@x.org>\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=q\n\n--q\nContent-Type: text/html\n\n<p>html</p>\n--q\nContent-Type: text/plain\n\nplain\n--q--\n")
    (tmp_path / "in" / "2.eml").write_bytes(b"\nonly a body \xff")
    assert {(r.path.rsplit("/", 1)[1], r.format) for r in X.scan(spark, str(tmp_path)).collect()} == {("x.MD", "Markdown"), ("1.eml", None), ("2.eml", None)}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(str(tmp_path / "in"))
    got = {r.path.rsplit("/", 1)[1]: r for r in X.mail_rows(files).collect()}
    assert (got["1.eml"].subject, got["1.eml"].sender_name, got["1.eml"].body.strip()) == ("Grüße", "Ann B", "plain")
    assert (got["2.eml"].subject, got["2.eml"].sender) == ("(No Subject)", "Unknown Sender") and got["2.eml"].body.startswith("only a body")


def test_result_links(spark):
    marked = '<div class="result__title"><a href="//r.example/?uddg=https%3A%2F%2Fa.org%2Fx&amp;k=1">First <b>title</b></a></div><a class="result__snippet">about it</a>'
    marked += '<div class="result__title"><a href="http://own.org/">Own one</a></div><div class="RESULT__TITLE"><a href="http://b.org/">abc</a></div><div class="result__title"><a href=\'http://c.org/?a=1&amp;b=2\'>éé</a></div><a href="http://d.org/">A plain link, not a result</a>'
    plain = '<a href="http://e.org/">ten bytes.</a><a href="http://f.org/">eleven here</a><a href="/rel">not resolved here</a><a href="mailto:x@y">mail address text</a>'
    rows = [(1, "u1", marked), (2, "u2", plain), (3, "u3", None), (4, "u1", plain), (5, "u5", '<p class="result__title">no link')]
    frame = spark.createDataFrame(rows, "id long, url string, html string")
    got = sorted((r.url, r["rank"], r.title, r.link, r.snippet) for r in X.result_links(frame, "url", "html", 5, ["own.org"]).collect())
    assert got == [("u1", 1, "First title", "https://a.org/x", "about it"), ("u1", 1, "eleven here", "http://f.org/", "eleven here"), ("u1", 2, "éé", "http://c.org/?a=1&b=2", ""), ("u2", 1, "eleven here", "http://f.org/", "eleven here")]
    assert X.result_links(frame, "url", "html", 1, ["own.org"]).count() == 3


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, v array<double>")
    new = spark.createDataFrame([(2, [5.0, 6.0])], "id long, v array<double>")
    assert sorted(map(tuple, X.upsert_vectors(old, new, "id", "v", 2).collect())) == [(1, [1.0, 2.0]), (2, [5.0, 6.0])]
    with pytest.raises(Exception, match="vector of length"):
        X.upsert_vectors(old, new, "id", "v", 3).collect()
    for _ in range(2):
        X.append_log(old.select("id"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_trails(spark):
    rows = [(0, "heading", 1, "A"), (1, "p", None, "x"), (2, "heading", 3, "C"), (3, "p", None, "y"), (4, "heading", 2, "B"), (5, "p", None, "z"), (6, "heading", 1, "D"), (7, "p", None, "w")]
    frame = spark.createDataFrame([(1, *r) for r in rows], "id long, pos long, kind string, level int, text string")
    assert [r.trail for r in C.heading_trails(frame).orderBy("pos").collect()] == ["A", "A › C", "A › B", "D"]


def test_chunks_keep_their_promises(spark):
    rng = np.random.default_rng(0)
    units, pos = [], 0
    for d in range(6):
        for _ in range(40):
            n = int(rng.choice([3, 20, 60, 400]))
            text = "| " + " | ".join(["cell é"] * n) + " |" if rng.random() < 0.2 else " ".join(["Wörter sind lang."] * n)
            units.append((d, pos, f"Part {pos // 9}", int(pos // 15), text))
            pos += 1
    frame = spark.createDataFrame(units, "id long, pos long, trail string, page long, text string")
    sizes = C.Sizes()
    got = C.pack(frame, sizes).orderBy("id", "index").collect()
    for d in range(6):
        own = [r for r in got if r.id == d]
        assert [r["index"] for r in own] == list(range(len(own)))
        words = " ".join(r.body for r in own)
        for u in units:
            if u[0] == d:
                assert u[4].split()[0] in words
    assert all(len(r.text.encode()) <= sizes.most for r in got)
    assert all(sum(c.isalnum() for c in r.body) >= 8 for r in got)
    assert {(r.trail, r.page) for r in got} <= {(u[2], u[3]) for u in units}
    small = [r for r in got if len(r.body.encode()) < sizes.least]
    assert len(small) < len(got) / 4


def test_chunks_lose_no_words(spark):
    text = "\n".join(f"Sentence {i} is about topic {i * 7}. It ends here." for i in range(200))
    frame = B.text_blocks(docs(spark, text), "id", "text", "\n")
    words = set(" ".join(r.body for r in C.chunk_texts(frame).collect()).split())
    assert set(text.split()) <= words


def test_embed_batches(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return np.array([[len(t), 1.0] for t in texts])

    got = {r.id: r for r in V.embed_batches(docs(spark, "abc", "bad", None, "line\n" * 1000), "id", "text", model, 2, batch=2, budget=100).collect()}
    assert got[0].embedded and not got[1].embedded and got[1].vector == [0.0, 0.0] and abs(np.linalg.norm(got[3].vector) - 1) < 1e-9


def test_pieces_follow_lines_and_cut_long_ones(spark):
    def brute(text, budget):
        if text is None or len(text) <= budget:
            return [text or ""]
        out, held = [], ""
        for line in text.split("\n"):
            parts = [line]
            if len(line) > budget:
                parts = []
                while len(line) > budget:
                    parts.append(line[:budget])
                    line = line[budget:].lstrip(" ")
                parts += [line] * bool(line)
            for part in parts:
                if held.strip() and len(held) + len(part) + 1 > budget:
                    out.append(held)
                    held = ""
                held = f"{held}\n{part}" if held else part
        return [p for p in [*out, held] if p.strip()] or [""]

    rng = np.random.default_rng(6)
    texts = [None, "", "short", " " * 50, "\n" * 40, "x" * 95, "ab " * 40, "é" * 31 + "\n" + "y" * 9]
    texts += ["\n".join("w" * int(rng.integers(0, 45)) + " z" * int(rng.integers(0, 3)) for _ in range(int(rng.integers(1, 12)))) for _ in range(60)]
    got = {r.id: r.p for r in docs(spark, *texts).select("id", V.text_pieces(F.col("text"), 20).alias("p")).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t, 20) for t in texts]


@pytest.mark.parametrize("spread", [None, 5])
def test_pieces_of_a_text_are_pooled_over_tasks(spark, spread):
    from loomdex.operators.index import hash_vectors

    texts = ["word number %d and more\n" % i * 40 for i in range(6)] + [None, "...", "one", "one"]
    frame = spark.createDataFrame([*enumerate(texts), (2, texts[2]), (None, "null id")], "id long, text string").repartition(3)
    rows = V.embed_batches(frame, "id", "text", lambda t: hash_vectors(t, 16), 16, batch=3, budget=100, spread=spread).collect()
    pieces = {r.id: r.p for r in frame.select("id", V.text_pieces(F.col("text"), 100).alias("p")).collect()}
    assert len(rows) == len(texts) + 2 and sum(r.id == 2 for r in rows) == 2
    for r in rows:
        mean = hash_vectors(pieces[r.id], 16).mean(axis=0)
        assert r.embedded and np.allclose(r.vector, mean / (np.linalg.norm(mean) or 1))


def test_dense_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(50)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {}
    for r in V.dense_top_k(frame, frame.where("id < 10").withColumnRenamed("id", "query_id"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    matrix = np.array([v for _, v in rows])
    for q in range(10):
        scores = matrix @ matrix[q]
        assert got[q] == [i for i in np.argsort(-scores, kind="stable")[:4].tolist() if scores[i] > 0]
    assert V.dense_top_k(frame, frame.limit(0).withColumnRenamed("id", "query_id"), 4).collect() == []


def test_dense_first_against_the_sequential_rule(spark):
    rng = np.random.default_rng(8)
    lists = {}
    for q in range(25):
        for name in ("d", "l"):
            ids = rng.permutation(12)[: rng.integers(0, 9)].tolist()
            lists[q, name] = ids
    frame = lambda name: spark.createDataFrame([(q, int(i), float(9 - n), n) for (q, k), ids in lists.items() if k == name for n, i in enumerate(ids)], "query_id long, id long, score double, rank long")
    for limit, reserved in ((5, 1), (4, 2), (6, 0)):
        got = {}
        for r in R.dense_first(frame("d"), frame("l"), limit, reserved).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for q in range(25):
            head = lists[q, "d"][: limit - reserved]
            out = head + [i for i in lists[q, "l"] if i not in head][:reserved]
            for i in lists[q, "d"] + lists[q, "l"]:
                out += [i] * (i not in out)
            assert got.get(q, []) == out[:limit]


def test_bm25_against_the_formula(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words[j] for j in rng.integers(0, 30, int(rng.integers(0, 25)))) for _ in range(60)] + [None, "w1 w1", "w1 w1"]
    asked = ["w1 w2 w2 zzz", "W3, w3", "nothing", "", None, "w5 w6 w7 w8 w9"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    index = build_index(frame)
    split = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]
    own = [split(t) for t in texts]
    mean = sum(map(len, own)) / len(own)
    assert index.size == len(own) and abs(index.mean - mean) < 1e-12
    expected = {}
    for q, text in enumerate(asked):
        scores = []
        for d, t in enumerate(own):
            total = 0.0
            for w in split(text):
                df = sum(w in x for x in own)
                total += np.log((len(own) - df + 0.5) / (df + 0.5) + 1) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean))
            if total > 0:
                scores.append((-round(total, 9), d))
        expected[q] = [(d, rank) for rank, (_, d) in enumerate(sorted(scores)[:7])]
    for products, block in ((1 << 20, 2048), (5, 2)):
        monkeypatch.setattr(R, "CHUNK_PRODUCTS", products)
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        got = {q: [] for q in expected}
        for r in R.bm25_top_k(queries, index, 7).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.id, r["rank"]))
        assert got == expected
    assert R.bm25_top_k(queries.limit(0), index, 7).collect() == []
    assert R.bm25_top_k(queries, build_index(frame.limit(0)), 7).collect() == []


def test_counted_words(spark):
    frame = spark.createDataFrame([(1, "a b a"), (2, None), (3, "."), (3, "b")], "doc_id long, text string")
    rows = count_words(frame)
    assert sorted((r.id, r.n, dict(zip(r.words, r.times)), r.vector is None) for r in rows.collect()) == [(1, 3, {"a": 2, "b": 1}, False), (2, 0, {}, True), (3, 0, {}, True), (3, 1, {"b": 1}, False)]
    assert sorted(map(tuple, word_totals(rows).collect())) == [("a", 1, 2), ("b", 2, 2)]


def test_top_k_is_limited_before_the_shuffle(spark):
    frame = spark.createDataFrame([(1, i, float(i % 5)) for i in range(50)], "g long, id long, score double")
    found = V.top_k(frame, "g", "score", "id", 3)
    assert [(r.id, r["rank"]) for r in found.orderBy("rank").collect()] == [(4, 0), (9, 1), (14, 2)]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_places_are_numbered_across_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x long").repartition(5)
    assert sorted(map(tuple, E._numbered(rows, "x").select("x", "i").collect())) == [(i, i) for i in range(101)]


def test_hits_of_documents_that_are_gone(spark):
    ranked = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2)], "query_id long, id long, rank long")
    kept = spark.createDataFrame([(10, "a"), (12, "c")], "doc_id long, name string")
    assert [(r.id, r["rank"]) for r in R.load_hits(ranked, kept).orderBy("rank").collect()] == [(10, 0), (12, 1)]


def test_anchors(spark):
    anchors = spark.createDataFrame([(1, "alpha beta gamma"), (1, "tail"), (2, "ta"), (3, "not there at all")], "query_id long, anchor string")
    texts = spark.createDataFrame([(10, "xalpha beta gammay tail"), (11, "alpha beta gamma"), (12, "data")], "doc_id long, text string")
    found = E.resolve_anchors(anchors, texts, build_index(texts))
    assert sorted(map(tuple, found.collect())) == [(1, 10), (2, 10), (2, 11), (2, 12)]
    assert [r.query_id for r in E.unresolved(anchors, found).collect()] == [3]


def test_statistics(spark):
    frame = spark.createDataFrame([(0, 0), (6, 0), (11, 3), (5, 5)], "w long, l long")
    got = [r.p for r in frame.select(E.sign_test(F.col("w"), F.col("l")).alias("p")).collect()]
    assert got[0] == 1 and abs(got[1] - 0.03125) < 1e-12 and abs(got[2] - 0.057373046875) < 1e-12 and got[3] == 1
    low, high = E.wilson(F.lit(43), F.lit(43))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert abs(r.l - 0.918) < 1e-3 and r.h == 1


def test_paths(spark):
    cases = {"a/b": None, "../x": "outside", "a/../../b": "outside", "/work/x": None, "/work": None, "/work/../etc": "outside", "/works": "outside", "/etc/x": "system", "/ETC": "system", "a/.ssh/k": "sensitive", "x/NUL": "device", "con.txt": "device", "console": None, "a\x00": "null byte"}
    frame = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.v for r in frame.select("p", P.path_verdict(F.col("p"), "/work").alias("v")).collect()} == cases


def test_bench_corpus_is_the_same_each_time(spark):
    a, b = X.bench_corpus(spark.range(100), 16), X.bench_corpus(spark.range(100).repartition(3), 16)
    rows, again = sorted(a.collect()), sorted(b.collect())
    assert rows == again and len(rows) == 100 and sum(r.asks for r in rows) == 3
    vectors = np.array([r.vector for r in rows])
    own = vectors @ vectors.T
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1) and own[:20, :20].mean() > own[:20, 20:].mean()
    assert len({r.body.split(".")[0] for r in rows}) > 3 and all(r.body.startswith(r.question) and len(r.question.split()) == 4 for r in rows)


def test_intake(spark):
    rows = [
        ("d/innocent.pdf", 10, True), ("d/.gitignore", 5, False), ("d/.gone", None, False), ("d/.linked", 5, True), ("d/gone.pdf", None, False), ("d/a.md", 5, False), ("d/a.md", 5, False), ("d/image.png", 5, False),
        ("d/link", 0, True), ("d/link/secret.md", 5, False), ("d/.secret/a.md", 5, False), ("d/.idea/a.md", 5, False), ("d/.vscode/b/a.md", 5, False), ("d/vendor/a.md", 5, False), ("d/empty.txt", 0, False), ("d/large.txt", (64 << 20) + 1, False),
        ("1/2/3/4/5/6/7/8/a.md", 5, False), ("1/2/3/4/5/6/7/8/9/a.md", 5, False), ("1/2/3/4/5/6/7/8/9/10/b.md", 5, False), ("1/2/3/4/5/6/7/8/.git/b.md", 5, False), (".x/2/3/4/5/6/7/8/9/a.md", 5, False), ("top.RS", 1, False),
    ]
    got = {r.path: r.reason for r in X.assess(spark.createDataFrame(rows, "path string, bytes long, is_symlink boolean")).collect()}
    assert got == {
        "d/innocent.pdf": "symbolic link", "d/.gone": "missing", "d/.linked": "symbolic link", "d/gone.pdf": "missing", "d/a.md": None, "d/image.png": "file type", "d/link": "symbolic link", "d/empty.txt": "empty", "d/large.txt": "too large",
        "1/2/3/4/5/6/7/8/a.md": None, "1/2/3/4/5/6/7/8/9": "too deep", "1/2/3/4/5/6/7/8/.git": "too deep", "top.RS": None,
    }


def test_sign_test_against_whole_numbers(spark):
    """p of counts up to a million, exactly: the tail in whole numbers, term by term from the largest."""
    from fractions import Fraction
    from math import comb

    def exact(wins, losses):
        n, m = wins + losses, min(wins, losses)
        if not n:
            return 1.0
        term = tail = comb(n, m)
        for i in range(m, 0, -1):
            term = term * i // (n - i + 1)
            tail += term
            # the rest is smaller than its place times this
            if term * m < tail >> 120:
                break
        return float(min(Fraction(1), Fraction(2 * tail, 1 << n)))

    cases = [(0, 0), (0, 1), (5, 0), (3, 3), (7, 2), (16, 15), (600, 500), (1100, 1000), (1000, 1100), (512, 512), (1023, 0), (2000, 1), (40_000, 39_000), (500_500, 499_500), (501_500, 498_500), (500_000, 500_000)]
    frame = spark.createDataFrame(cases, "wins long, losses long")
    for r in frame.select("wins", "losses", E.sign_test(F.col("wins"), F.col("losses")).alias("p")).collect():
        assert abs(r.p - exact(r.wins, r.losses)) < 1e-9, r
        assert exact(r.wins, r.losses) < 1e-200 or abs(r.p / exact(r.wins, r.losses) - 1) < 1e-8, r


def test_sketches_of_days_merge_within_their_rank_error(spark):
    from loomdex.operators import tables as A

    rng = np.random.default_rng(2)
    values = [float(x) for x in rng.lognormal(size=4000)] + [5.0] * 3000 + [None] * 10
    frame = spark.createDataFrame([("a" if i % 3 else "b", i % 7, v) for i, v in enumerate(values)], "g string, day int, v double").union(spark.createDataFrame([(None, 1, 2.0)], "g string, day int, v double"))
    shares = {"low": 0.05, "mid": 0.5, "top": 1.0}
    found = A.sketched_percentiles(A.value_sketches(frame, ["g", "day"], "v"), "g", shares)
    rows = {r.g: r for r in found.collect()}
    assert set(rows) == {"a", "b", None} and rows["a"].sketches == 7 and rows["a"].n + rows["b"].n + rows[None].n == 7001
    for r in A.rank_errors(frame, "g", "v", found, shares).collect():
        assert max(r.low, r.mid, r.top) <= 0.01
