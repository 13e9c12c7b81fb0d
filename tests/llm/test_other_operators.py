"""Language ID, HTML, URLs, chat, mixing, neighbours and the pipeline against brute force, round trips or held-out labels."""

import hashlib
import math
import re

import numpy as np
import pytest
from loomdex.llm import ann, html_template, langid
from loomdex.llm.ann import nearest
from loomdex.llm.chat_format import best_branches, format_conversations, read_back
from loomdex.llm.html_template import ROLES, extract_text, main_blocks, parse, template_roles, template_tokens, visible_text
from loomdex.llm.langid import UNKNOWN, identify, train
from loomdex.llm.mixing import mix_sources, training_order
from loomdex.llm.queries import queries
from loomdex.llm.url_filter import RULES, bloom_filter, canonical, filter_urls
from pyspark.sql import functions as F


# ---- language ----


def test_held_out_accuracy_of_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = docs.where("doc_id % 2 = 0")
    model = train(fitted, sample=300)
    judged = identify(docs.where("doc_id % 2 = 1"), model, "text").collect()
    right = sum(r.language == r.lang for r in judged)
    assert right / len(judged) > 0.97, right / len(judged)


def test_evidence_is_fused(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs, sample=300)
    rows = [(1, None, "h", "de", "de"), (2, "", "h", "", ""), (3, "zz9 qqxj wvvk zzqx jkqz xxkq vvqj zkxq wqzx", "h", None, None), (4, "", None, "fr", None)]
    frame = spark.createDataFrame(rows, "id long, text string, host string, m string, a string")
    got = {r.id: r for r in identify(frame, model, "text", host=F.col("host"), markup_lang=F.col("m"), address_lang=F.col("a")).collect()}
    assert got[1].language == "de" and got[4].language == "fr" and got[1].confidence > got[4].confidence
    assert all(0 < got[i].confidence <= 1 for i in got) and set(got) == {1, 2, 3, 4}


def brute_languages(rows, model):
    """(language, confidence, text language) of rows (id, text, host, markup, address) by plain sums over one text at a time."""
    names, logs = model
    n = len(names)
    logs = logs.astype(np.float32).astype(float)
    flat = np.array([langid.UNKNOWN_PRIOR if x == UNKNOWN else (1 - langid.UNKNOWN_PRIOR) / max(1, n - 1) for x in names])
    likelihoods, soft = [], []
    for _, text, *_ in rows:
        sound = re.sub("[^a-z\u0080-\U0010ffff]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).encode()
        total, count = np.zeros(n), 0
        for i in range(len(sound) - 2):
            a, b, c = sound[i : i + 3]
            if (a != 32 or b != 32) and (b != 32 or c != 32):
                h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
                h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
                total += logs[:, h >> (32 - 14)]
                count += 1
        total *= min(1, langid.EVIDENCE / count) if count else 1
        p = total + np.log(flat)
        p = np.exp(p - p.max())
        likelihoods.append(total)
        soft.append(p / p.sum())
    domain = lambda h: m[0] if (m := re.search(r"[^.]+\.[^.]+$", h)) else ""
    hosts = [r[2] or "" for r in rows]
    lean = lambda own, above: (own + langid.STRENGTH * above) / (own.sum() + langid.STRENGTH)
    out = []
    for (_, _, _, markup, address), like, s, host in zip(rows, likelihoods, soft, hosts):
        everything = lean(sum(soft), flat)
        in_domain = lean(sum(x for x, h in zip(soft, hosts) if domain(h) == domain(host)), everything)
        p = like + np.log(lean(sum(x for x, h in zip(soft, hosts) if h == host), in_domain))
        for code, trust in ((markup, langid.MARKUP_TRUST), (address, langid.ADDRESS_TRUST)):
            if code in names:
                p = p + np.log([trust if x == code else (1 - trust) / max(1, n - 1) for x in names])
        p = np.exp(p - p.max())
        p /= p.sum()
        out.append((names[int(p.argmax())], p.max(), names[int(s.argmax())]))
    return out


def test_posteriors_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs, sample=200)
    rng = np.random.default_rng(3)
    texts = [r.text[: int(rng.integers(1, 300))] for r in docs.orderBy("doc_id").limit(70).collect()]
    texts += [None, "", "  ", "7 . 8", "ab", "Ünïcode ÉÉ", texts[0], " ".join(texts) * 40]
    hosts = ["a.x.org", "b.x.org", "x.org", "y.com", "", None, "deep.er.z.net"]
    codes = ["de", "fr", None, "", "xx", "es"]
    rows = [(i, t, hosts[i % 7], codes[int(rng.integers(6))], codes[int(rng.integers(6))]) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, *rows[4][1:])]
    # extra columns that clash with those of the result, and a column named like a part of the plan
    frame = spark.createDataFrame([(*r, "clash", 1.0, "h") for r in rows], "id long, text string, host string, m string, a string, language string, confidence double, h string").repartition(3)
    judged = identify(frame, model, "text", host=F.col("host"), markup_lang=F.col("m"), address_lang=F.col("a"))
    assert judged.columns == ["id", "host", "m", "a", "h", "language", "confidence", "text_language"]
    got = sorted((-1 if r.id is None else r.id, r.language, r.confidence, r.text_language) for r in judged.collect())
    expected = sorted((-1 if r[0] is None else r[0], *e) for r, e in zip(rows, brute_languages(rows, model)))
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert (g[0], g[1], g[3]) == (e[0], e[1], e[3]) and math.isclose(g[2], e[2], rel_tol=1e-4), (g, e)


def test_rows_without_an_id_or_a_label_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, "zzz zzz", "de"), (5, None, "de"), (6, "zzz", None)], docs.schema)
    model, again = train(docs, sample=100), train(docs.union(odd), sample=100)
    assert model[0] == again[0] and np.allclose(model[1], again[1])


def test_host_priors_decide_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs, sample=300)
    long = docs.where("lang = 'es' and n_chars > 500").select("doc_id", "text", F.lit("es.host.org").alias("host"))
    frame = long.union(spark.createDataFrame([(-1, "", "es.host.org"), (-2, "", "other.org")], "doc_id long, text string, host string"))
    got = {r.doc_id: r for r in identify(frame, model, "text", host=F.col("host")).collect()}
    assert got[-1].language == "es" and got[-1].confidence > 0.8 and got[-2].confidence < got[-1].confidence


def test_random_bytes_are_in_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(0)
    junk = [(i, " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(200))) for i in range(5)]
    got = identify(spark.createDataFrame(junk, "doc_id long, text string"), train(docs, sample=300), "text").collect()
    assert {r.language for r in got} == {UNKNOWN}


def test_language_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train(empty)
    assert model[0] == [UNKNOWN]
    assert identify(empty, model, "text").collect() == []


# ---- html ----


def page(*, nav="Home", body="", foot="c"):
    return f'<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>";</script><style>p{{}}</style></head><body><nav><ul><li><a href="/">{nav}</a></ul></nav>{body}<footer>{foot}</footer></body></html>'


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (page(body="<article><h1>Title &amp; more</h1><p>One\n  two &#233;&nbsp;x<p>three <b>bo</b>ld<br>four</article>"), "Title & more One two é x three bold four"),
        (page(body='<div class="ad">buy</div><article><p>a</p><aside>side</aside><div id="comments"><p>reader</p></div><form><label>mail</label></form><p>b</p></article>'), "a b"),
        (page(body='<header>Site</header><div class="cookie-notice">ok?</div><main><p>x</p></main>'), "x"),
        ("<p>no article</p><p>at all<!-- hidden --></p><div class='sidebar'>s</div>", "no article at all"),
        ("<article><p>open <i>never closed<p>next", "open never closed next"),
        ("<article>1 < 2 and a<b</article>", "1 < 2 and a"),
        ("<article>x<!-- never closed <p>y", "x"),
        ("<article>x<script>never closed <p>y", "x"),
        ("<article><img alt='>'>x<a title=\"</article>\">y</a></article>z", "xy"),
        ("plain", "plain"),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(spark, html, text):
    frame = spark.createDataFrame([(1, "http://h/x", html, "clash")], "page_id long, url string, html string, text string")
    assert [r.text for r in extract_text(frame).collect()] == [text]


def test_template_texts_are_not_content(spark):
    rows = [(i, "http://site.org/x", page(body=f"<div class='story'><p>Share this story</p><p>story number {i}</p></div>")) for i in range(12)]
    rows += [(50 + i, "http://copies.org/x", page(body="<p>same text</p>")) for i in range(12)]
    rows += [(90, None, None), (91, "x", "")]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story number 3" and got[55] == "same text" and got[90] == got[91] == ""


def sites():
    """Small sites: two layouts on one host, unnamed furniture, articles that are teasers, copies, a host of too few pages."""
    rng = np.random.default_rng(4)
    draw = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 500, n))
    links = lambda n: "".join(f'<li><a href="/{k}">{draw(2)}</a></li>' for k in range(n))
    rows = []
    for i in range(14):
        body = f'<div class="x1"><ul>{links(5)}</ul></div><div class="x2"><h2>{draw(4)}</h2><p>{draw(30)}</p></div><div class="x3"><p>All rights reserved by nobody</p></div>'
        rows.append(("plain.org", f"<html><body>{body}</body></html>", ["x2"]))
    for i in range(12):
        rows.append(("two.org", f"<html><body><nav>{links(3)}</nav><article><h1>{draw(3)}</h1><div class='search'><p>{draw(60)}</p></div><p class='related-work'>{draw(5)}</p></article><div class='z'>{draw(9)}</div></body></html>", None))
        rows.append(("two.org", f"<html><body><nav>{links(3)}</nav><div class='q'><h1>{draw(40)}</h1></div><div class='teasers'><article>{draw(2)}</article></div></body></html>", None))
    rows += [("copies.org", "<html><body><article><p>the same</p></article></body></html>", None)] * 10
    rows += [(f"few{k % 5}.org", f"<html><body><div class='menu'>{draw(3)}</div><div class='k'>Made by k</div><p>{draw(20)}</p></body></html>", None) for k in range(20)]
    rows += [("few1.org", None, None), ("few1.org", "", None)]
    return [(i, f"http://{host}/{i}", html) for i, (host, html, _) in enumerate(rows)]


def brute_roles(pages):
    """Tokens by role, from whole occurrence vectors."""
    stats = {}
    for i, html in enumerate(pages):
        page = parse(html)
        texts = {}
        for at, text, linked in page.blocks:
            stats.setdefault((html_template._text_token(page.tokens[at], text), True), {}).setdefault(i, [0, len(text) - linked, linked, "", 0])[0] += 1
            while at >= 0:
                texts.setdefault(page.tokens[at], []).append((text, linked))
                at = page.parents[at]
        for token in set(page.tokens):
            own = texts.get(token, [])
            marks = [m for t, m in zip(page.tokens, page.marks) if t == token]
            stats.setdefault((token, False), {})[i] = [len(marks), sum(len(t) - n for t, n in own), sum(n for _, n in own), sorted(t for t, _ in own), max(marks)]
    whole = {i: s[1] for i, s in stats[0, False].items()}
    vary = len({tuple(s[3]) for s in stats[0, False].values()}) > 1
    classes = {}
    for key, own in stats.items():
        if len({pages[i] for i in own}) >= html_template.MIN_PAGES and len(own) >= (0.5 if key[1] else html_template.SUPPORT) * len(pages):
            classes.setdefault(tuple(sorted((i, s[0]) for i, s in own.items())), []).append(key)
    roles = {name: set() for name in ROLES}
    for members in classes.values():
        if sum(1 if is_text else 2 for _, is_text in members) < html_template.MIN_TOKENS:
            continue
        for token, is_text in members:
            own = stats[token, is_text]
            plain, linked = (sum(s[k] for s in own.values()) for k in (1, 2))
            most = not is_text and plain >= 0.5 * sum(whole[i] for i in own) and plain > 0
            same = vary and (is_text or (len({tuple(s[3]) for s in own.values()}) == 1 and plain + linked > 0))
            article = max(s[4] for s in own.values()) == 1
            constant = not is_text and not most and not article and same and len(own) >= 0.5 * len(pages)
            for name, holds in zip(ROLES, (article and most, article and not most, most, not most and (same or linked > plain), constant)):
                if holds:
                    roles[name].add(token)
    return roles


def test_templates_equal_brute_force(spark, monkeypatch):
    # different pages are told apart by residues, which small sites may share
    monkeypatch.setattr(html_template, "MIN_PAGES", 6)
    rows = sites()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = template_roles(template_tokens(frame.select(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), "html"))).collect()
    got = {r.site: {name: set(r[name]) for name in ROLES} for r in found}
    by_site = {}
    for _, url, html in rows:
        host = url.split("/")[2]
        if html:
            by_site.setdefault(host if host in ("plain.org", "two.org") else None, []).append(html)
    assert got == {site: brute_roles(pages) for site, pages in by_site.items()}
    texts = {r.page_id: r.text for r in extract_text(frame).collect()}
    for i, url, html in rows:
        host = url.split("/")[2]
        assert texts[i] == " ".join(main_blocks(parse(html or ""), *got[host if host in got else None].values()))


def test_the_template_decides_what_is_text(spark):
    rows = sites()
    texts = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    none = lambda html: " ".join(main_blocks(parse(html or ""), *[set()] * 5))
    for i, url, html in rows[:14]:
        # a list of links and a constant text without telling names
        assert texts[i] == re.sub("<[^>]*>", " ", html.split('"x2">')[1].split("</div>")[0]).strip().replace("   ", " ").replace("  ", " ") and texts[i] != none(html)
    for i, url, html in rows[14:38]:
        words = set(re.findall(r"w\d+", html.split("</nav>")[1]))
        if "teasers" in html:
            # a small article is no main slot
            assert set(texts[i].split()) == words and texts[i] != none(html)
        else:
            # a slot of most of the text is content, whatever it is called; what is outside the main slot is not
            assert len(texts[i].split()) == 68 and texts[i] != none(html)
    assert {texts[i] for i, url, _ in rows if "copies" in url} == {"the same"}
    assert all(len(texts[i].split()) == 20 for i, url, html in rows if "few" in url and html)


@pytest.mark.parametrize("tag", ["article", "div"])
def test_a_constant_slot_inside_the_main_one_is_no_content(spark, tag):
    """A notice without a telling name that every page repeats inside its article goes; headings and paragraphs that differ stay, and so does what only copies share."""
    rng = np.random.default_rng(31)
    rows, expected = [], {}
    for i in range(30):
        words = [" ".join(f"w{rng.integers(10_000)}" for _ in range(12)) for _ in range(3)]
        copy = i >= 24
        words = ["copied text one", "copied text two", "copied text three"] if copy else words
        body = f"<h1>Title {i}</h1><p>{words[0]}</p>" + ("" if i == 5 else '<div class="q7"><p>Read our rules before <b>you</b> go on.</p><p>Thank you.</p></div>') + f"<p>{words[1]}</p><p>{words[2]}</p>"
        rows.append((i, f"http://made.org/{i}", f'<html><body><div class="z1"><a href="/">Home</a></div><{tag}>{body}</{tag}><div class="z9">All rights</div></body></html>'))
        expected[i] = " ".join([f"Title {i}", *words])
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected


def test_repeated_pages_and_empty_tables(spark):
    rows = sites()
    frame = spark.createDataFrame(rows + rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in extract_text(frame).collect()]
    assert len(got) == 2 * len(rows) and len(set(got)) == len(rows)
    empty = extract_text(frame.limit(0))
    assert empty.columns == ["page_id", "url", "text"] and empty.collect() == []


def test_very_long_and_hostile_pages():
    for html in ("<" * 50_000, '<a "' * 20_000, "<div>" * 5_000 + "x", "<p class='" + "a" * 200_000, "&" * 100_000, "<head>" * 20_000, "</b>" * 50_000, "<!-" * 50_000 + ">"):
        parse(html)
    assert main_blocks(parse("<div>" * 300 + "deep" + "<nav>menu</nav>"), *[set()] * 5) == ["deep"]


# ---- urls ----


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_rules_and_lists(spark):
    urls = [
        None, "", "nothing", "http://net/", "http://a.net/x", "http://A.Example.NET/en/1", "http://example.net/en", "https://x.example.com/de/", "http://badexample.com/de/", "http://q.org/fr/?a=://b/c",
        "http://org/fr/", "http://net", "http://x.com?y/z", "http://x.com#f", "//x", "http://spam.com/a", "http://www.spam.com/a/", "http://m.spam.com/a.html?utm_source=q#t", "http://spam.com/b", "http://spam.com/a?x=1&ref=2", "ftp://É.net/é",
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, None, "clash")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://SPAM.com/a",), ("http://spam.com/a?x=1",), (None,)], "url string")
    got = {r.page_id: r for r in filter_urls(pages, listed).collect()}
    block = {15, 16, 17, 19}
    for i, u in enumerate(urls):
        host, path = brute_url(u)
        rules = [(len(n), n, v) for n, v in RULES if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith("/" + n.split("/", 1)[1])]
        _, rule, verdict = max(rules, default=(0, None, "block" if i in block else "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert filter_urls(pages.limit(0), listed).collect() == [] and filter_urls(pages, listed.limit(0)).count() == len(urls) + 1


def test_filter_has_no_false_negatives_and_a_fixed_size(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = bloom_filter(keys, 300)
    assert bloom.count() <= 300
    urls = spark.range(3000).select(F.concat(F.lit("http://k"), "id").alias("url"))
    assert filter_urls(urls, urls).where("verdict <> 'block'").count() == 0
    assert urls.select(canonical(F.col("url")).alias("c")).where("c is null").count() == 0


# ---- chat ----

MESSAGES = "conv long, msg long, parent long, score double, role string, text string"


def test_best_branch_of_reply_trees(spark):
    rng = np.random.default_rng(2)
    rows = []
    for conv in range(12):
        for msg in range(int(rng.integers(1, 40))):
            parent = None if msg == 0 or rng.random() < 0.05 else int(rng.integers(0, msg))
            rows.append((conv, msg, parent, float(rng.integers(0, 5)), "user", "x"))
    rows += [(99, 1, 2, 1.0, "user", "x"), (99, 2, 1, 1.0, "user", "x"), (99, 3, 77, None, "user", "orphan"), (None, 1, None, 1.0, "user", "x"), (None, 2, 1, 1.0, "user", "x")]
    rows += [(100, i, i - 1 if i else None, 1.0, "user", "deep") for i in range(300)]
    expected = set()
    for conv in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == conv}
        paths = []
        for leaf in own:
            if any(r[2] == leaf for r in own.values()):
                continue
            path, at = [], leaf
            while at is not None and at in own and at not in path:
                path.append(at)
                at = own[at][2]
            paths.append((-sum(own[m][3] or 0 for m in path), leaf, path))
        if paths:
            _, _, path = min(paths)
            expected |= {(conv, m, len(path) - i) for i, m in enumerate(path)}
    got = {(r.conv, r.msg, r.depth) for r in best_branches(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got == expected


def test_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "&lt; & &amp;#91;", "", None, "|>\n", "é😀 ", "x" * 50_000, "<|end|>", "\\n\\", "[[", "a\n\nb\n"]
    rows = [(1, i, i - 1 if i else None, 1.0, ["user", "assistant", "sys|>tem", None][i % 4], t) for i, t in enumerate(hard)] + [(2, 0, None, None, "assistant", None)]
    got = {r.conv: r for r in read_back(format_conversations(spark.createDataFrame(rows, MESSAGES))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[4] or "", r[5] or "") for r in rows[:-1]]
    assert got[1].loss_text == "".join(r[5] or "" for r in rows[:-1] if r[4] == "assistant")
    assert (len(got[2].turns), got[2].loss_text) == (1, "")
    # repeated messages, and columns that clash with those of the result
    again = spark.createDataFrame([(*r, "x", 1) for r in rows * 2 + [(1, 0, 5, None, "zz", "later")]], MESSAGES + ", formatted string, depth int")
    assert sorted(map(str, read_back(format_conversations(again)).collect())) == sorted(map(str, got.values()))
    assert format_conversations(again.limit(0)).collect() == []
    assert format_conversations(spark.createDataFrame([], MESSAGES)).collect() == []


def test_chat_query(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/conversations.parquet").collect() + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t, role, text or ""))
    got = {r.conv_id: r for r in queries()["op5_chat_format"](spark, tiny).collect()}
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---- mixing ----


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), sum(sizes.values())
    while True:
        share = sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and left * weight[s] / share > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / share for s in names if s not in full}
        for s in over:
            target[s] = 3 * sizes[s]
            full.add(s)
        left = sum(sizes.values()) - sum(target.values())


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s, n in {"a": 400, "b": 3, "é": 50, "Z": 120, None: 30, "c": 2, "d": 0}.items():
        rows += [(len(rows) + i, " ".join(["w"] * int(rng.integers(0, 60))), s) for i in range(n)]
    rows += [(None, "w w", "b"), (None, None, None), (9000, None, "a"), (9001, "", "e"), (9002, " ".join(["w"] * 20_000), "a"), rows[5], rows[5]]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, bucket int").repartition(5)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = brute_targets(sizes)
    got = mix_sources(frame).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        # a take for each pass, later passes later
        assert sum(t.words for t in r.takes) == r.taken and len(r.takes) <= 3 and [t.position for t in r.takes] == sorted(t.position for t in r.takes)
        assert r.position == (r.takes[0].position if r.takes else None) and all(0 <= t.position <= 1 and 0 < t.words <= r.size for t in r.takes)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    order = training_order(mix_sources(frame)).collect()
    assert [t.position for t in order] == sorted(t.position for t in order) and sum(t.words for t in order) == sum(taken.values())
    again = mix_sources(frame.repartition(2)).collect()
    key = lambda r: (r.id or -1, r.size, r.taken, r.position or -1)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_later_passes_come_later(spark):
    rows = [(i, "w " * 10, "s") for i in range(50)] + [(100 + i, "w " * 10, "t") for i in range(2000)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1), slopes=(0.0, 0.0)).where("source = 's'").collect()
    assert all(len(r.takes) == 3 for r in got)
    firsts, lasts = [r.takes[0].position for r in got], [r.takes[2].position for r in got]
    assert max(firsts) < 1 / 3 < 2 / 3 < min(lasts) and max(lasts) > 0.98


def test_schedules_shift_sources(spark):
    rows = [(i, "w " * 50, "abc"[i % 3]) for i in range(3000)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1, 1), slopes=(0.9, 0.0, -0.9)).collect()
    mean = {s: np.mean([r.position for r in got if r.source == s]) for s in "abc"}
    assert mean["a"] > mean["b"] + 0.1 > mean["c"] + 0.2


def test_as_many_sources_as_documents(spark):
    # every document is a host of its own
    rows = [(i, " ".join(["w"] * (1 + i % 7)), f"host{i:04d}.org") for i in range(500)]
    target = brute_targets({s: len(t.split()) for _, t, s in rows})
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(math.isclose(r.target, target[r.source], rel_tol=1e-9) for r in got) and len(got) == 500


def test_mix_of_an_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


# ---- neighbours ----


def brute_nearest(rows, k):
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], float)
    out = {}
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        scores = matrix @ matrix[ids == q][0]
        keep = ids != q
        order = np.lexsort((ids[keep], -scores[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), scores[keep][order].tolist()))
    return out


def recall_of(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    expected = brute_nearest(rows, 20)
    got = {}
    for r in queries()["op8_nearest"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(expected)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == 20 and q not in {v for v, _ in found}
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) / 20 for q in expected])


def test_recall(spark):
    assert recall_of(spark, "/root/testdata/sf0.1") >= 0.9


@pytest.mark.parametrize("kind", ["unit", "half", "wide", "groups"])
def test_recall_at_any_spread_of_lengths(spark, kind):
    """Vectors without structure of one length and of lognormal lengths (sigma 0.5 and 1), and groups with lengths of sigma 0.7."""
    rng = np.random.default_rng(88)
    v = rng.normal(size=(3000, 64))
    if kind == "groups":
        v = rng.normal(size=(40, 64))[rng.integers(40, size=len(v))] + 0.3 * v
    v *= np.exp({"unit": 0, "half": 0.5, "wide": 1.0, "groups": 0.7}[kind] * rng.normal(size=(len(v), 1))) / np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in nearest(frame, frame.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert math.isclose(r.score, float(v[r.query_id] @ v[r.vec_id]), rel_tol=1e-9, abs_tol=1e-12)
    share = []
    for q in range(0, len(v), 20):
        scores = v @ v[q]
        scores[q] = -np.inf
        share.append(len(found[q] & set(np.argsort(-scores, kind="stable")[:20].tolist())) / 20)
    assert len(found) == len(share) and np.mean(share) >= 0.9, np.mean(share)


def test_recall_over_many_files_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "FILE_ROWS", 40)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "WIDER", 3)
    recall = recall_of(spark, "/root/testdata/sf0.1")
    assert recall >= 0.9, recall


def test_few_odd_and_equal_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(15)] + [(20 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(90)]
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (220, []), (None, [1.0] * 4), (205, [1.0, 2.0])]
    # repeated rows are one candidate; a clashing column changes nothing
    frame = spark.createDataFrame([(*r, 1) for r in rows + odd + rows[:3]], "vec_id long, embedding array<float>, rank int")
    rows = [(i, np.array(v, np.float32)) for i, v in rows]
    got = {}
    for r in nearest(frame, frame.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [v for v, _ in found] for q, found in brute_nearest(rows, 20).items()}
    few = frame.where("vec_id < 4")
    assert nearest(few, few.where("vec_id = 0")).count() == 3
    assert nearest(frame.limit(0), frame.limit(0)).collect() == []


def test_equal_vectors_by_the_thousand(spark, monkeypatch):
    monkeypatch.setattr(ann, "FILE_ROWS", 10)
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(3000)] + [(5000 + i, [float(i), 1.0, -1.0]) for i in range(1, 61)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(frame, frame.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {i for i, _ in rows if i % 100 == 0} and all(len(v) == 20 for v in got.values())


# ---- pipeline ----


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, tiny)
        assert new.columns == columns, name
        before, after = kept.count(), new.count()
        assert 0.5 * before < after <= before, name
        kept = new
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, tiny)
    assert mixed.count() == kept.count() and {"doc_id", "taken", "position"} <= set(mixed.columns)


def test_pipeline_keeps_odd_rows_without_crashing(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    odd = spark.createDataFrame([(None, "x y", None, None, None), (10**6, None, "en", "s", None), (10**6 + 1, "", None, None, 0), (10**6 + 1, "", None, None, 0)], docs.schema)
    for frame in (docs.limit(30).union(odd), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, tiny).collect()


def test_unbalanced_signs_of_markup_hide_no_text_and_show_no_tags():
    page = '<p>one</p><script>for (i=0;i<n;i++) x => y</script><!-- a < b --><style>p > a {}</style><b title="x">two</b> 1 < 2 => <i class="q">three</i> &amp; four'
    assert visible_text(page).split() == ["one", "two", "1", "<", "2", "=>", "three", "&", "four"]


def test_text_after_an_unbalanced_sign_is_evidence(spark):
    words = {"aa": "lorem ipsum dolor sit amet ", "bb": "zwölf boxkämpfer jagen viktor quer "}
    docs = spark.createDataFrame([(i, words[x] * 9, x) for i, x in enumerate(["aa", "bb"] * 20)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "<script>for (i=0;i<n;i++)</script><p>" + words["aa"] * 9), (2, "<p>1 < 2 " + words["bb"] * 9)], "id long, text string")
    got = identify(pages, train(docs), "text", markup=True).collect()
    assert {r.id: r.text_language for r in got} == {1: "aa", 2: "bb"} and all(r.confidence > 0.9 for r in got)


def test_rare_languages_are_trained_beside_hot_ones(spark):
    rows = [(i, "some hot words of the large language", "hot") for i in range(3000)] + [(5000 + i, f"rare{i} yyy zzz", f"r{i:02}") for i in range(80)]
    names, logs = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20)
    assert names == ["hot", *(f"r{i:02}" for i in range(80)), UNKNOWN] and len(logs) == 82
