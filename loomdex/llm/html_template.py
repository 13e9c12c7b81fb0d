"""Main text of web pages by template deduction from equivalence classes of tokens.

A page is a sequence of tokens: tags by their path from the root (names, classes, ids
and roles, without digits), and text blocks by their path and text. Over the pages of
a host, a token's occurrence vector says how often it stands in each page; tokens
with equal vectors form a class. Vectors are compared by two sums of page hashes
weighted by occurrences, so classes are grouped aggregates and no vector is
gathered. A class is valid if it stands in `SUPPORT` of the host's pages, of which
`MIN_PAGES` differ, and has `MIN_TOKENS` tokens (an element is two tags). Several
layouts of a host are several classes. Valid classes nest: an element's path says in
which elements of other classes it stands, on every page, before and after what it
holds. The nested classes are the host's template; what their elements hold are its
slots. Hosts of too few pages are one site together.

What fills a slot on all pages decides what it is (`template_roles`):

* the main slot is an article or main element that holds at least half of the plain
  text of the pages it stands in; where a page has it, nothing outside is text;
* a slot whose text is the same on all pages, or is mostly links, is furniture, if it
  holds less than half of the plain text;
* a slot of at least half of the plain text is content, whatever it is called.

Only what the template leaves open (slots inside the main one, small slots of varying
plain text, elements that few pages have) goes by names: menus, headers, footers,
sidebars, notices, adverts, forms and comments are known by tag, role or class words.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.shared import cut

from .url_filter import host_of

MIN_PAGES = 8
MIN_TOKENS = 3
SUPPORT = 0.1
#: The share of plain text that makes a slot the main one, and of links that makes it a list of links.
MOST = 0.5
#: Templates of at most this many sites and tokens are broadcast; more are joined by host.
BROADCAST_ROWS, BROADCAST_TOKENS = 20_000, 500_000
#: Sites whose templates a task holds unpacked.
KEPT_SITES = 1000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_OPEN_COMMENT = re.compile(r"<!--.*\Z()()()()()()", re.S)
_ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
# Element names by their part in a page.
_RAW = frozenset("script style noscript template svg textarea iframe title head select math object audio video canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_SKIP_TAGS = frozenset("nav footer aside form button dialog menu".split())
_MAIN_TAGS = frozenset("article main".split())
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
_PLAIN_TAGS = frozenset("html body article main".split())
# Class, id and role words of page furniture.
_SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead footer comment comments disqus respond reply replies share sharing social related recommended "
    "widget widgets toolbar login search contentinfo complementary dialog".split()
)
_CLOSES = {"li": "li", "tr": "tr", "td": "td", "th": "th", "dt": "dt", "dd": "dd", "option": "option"}


class Page:
    """A parsed page: its elements in order (token, parent, mark) and its text blocks (element, text, characters inside links).

    Element 0 is the page itself. A mark tells what an element's name says: -1
    furniture, 1 article, 0 nothing.
    """

    def __init__(self):
        self.tokens: list[int] = [0]
        self.parents: list[int] = [-1]
        self.marks: list[int] = [0]
        self.blocks: list[tuple[int, str, int]] = []


def _token(parent: int, name: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent}\x00{name}".encode("utf-8", "surrogatepass")) - 2**63


def _text_token(parent: int, text: str) -> int:
    return _token(parent, "\x00" + text)


def _signature(name: str, attributes: str) -> tuple[str, frozenset[str]]:
    """An element's name with its classes, ids and roles, digits left out, and their words; only whole names of a paragraph or the like."""
    if not attributes:
        return name, frozenset()
    told = [_DIGITS.sub("", "".join(a).lower()) for a in _ATTRIBUTE.findall(attributes)]
    words = (w for x in told for w in (x.split() if name in _TEXT_TAGS else _WORD.findall(x)))
    return " ".join([name, *told]), frozenset(words)


def parse(page: str) -> Page:
    """Elements and text blocks of a page; broken markup is closed where a browser would, or at the end."""
    out = Page()
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    unended: set[str] = set()
    parts: list[str] = []
    at, inside, links, linked = 0, 0, 0, 0
    articles = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.blocks.append((inside, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(name):
        nonlocal inside, links, articles
        while opened[name]:
            top, inside = stack.pop()
            opened[top] -= 1
            links -= top == "a"
            articles -= top in _MAIN_TAGS
            if top == name:
                return

    def take(text):
        nonlocal linked
        parts.append(text)
        if links > 0:
            linked += len(text)

    def element(name, mark=0, signature=None):
        out.tokens.append(_token(out.tokens[inside], signature or name))
        out.parents.append(inside)
        out.marks.append(mark)
        return len(out.tokens) - 1

    end, last = len(page), page.rfind(">")
    while at < end:
        # without a > to come there is no tag but an open comment
        m = _TAG.search(page, at) if at <= last else _OPEN_COMMENT.search(page, at)
        if m is None:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name not in _INLINE:
            flush()
        if closing:
            if name in _INLINE and opened[name] and inside != stack[-1][1]:
                flush()
            close(name)
            continue
        if name in _RAW and not attributes.rstrip().endswith("/"):
            ending = None if name in unended else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if ending is not None:
                at = ending.end()
            elif name != "head":
                at = end
            else:
                unended.add(name)
            element(name)
            continue
        if name in _CLOSES and any(s[0] == name for s in stack[-2:]):
            close(name)
        if name not in _INLINE and name != "br":
            close("p")
        if name in _VOID:
            if name not in _INLINE:
                element(name)
            continue
        signature, words = _signature(name, attributes)
        furniture = name in _SKIP_TAGS or (name == "header" and not articles)
        if not furniture and words and name not in _PLAIN_TAGS:
            furniture = not words.isdisjoint(_SKIP_WORDS) or ("header" in words and not articles)
        own = inside
        # inline elements are no elements of the template, unless their names set them apart
        if name not in _INLINE or furniture:
            if name in _INLINE:
                flush()
            own = element(name, -1 if furniture else int(name in _MAIN_TAGS), signature)
        stack.append((name, inside))
        opened[name] += 1
        inside = own
        links += name == "a"
        articles += name in _MAIN_TAGS
    flush()
    return out


def visible_text(page: str) -> str:
    """A page's text without tags, comments, scripts and styles; a < that opens no tag is text."""
    parts: list[str] = []
    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        m = _TAG.search(page, at) if at <= last else _OPEN_COMMENT.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if name not in _INLINE:
            parts.append(" ")
        if name in ("script", "style") and not (m[1] or m[4]):
            ending = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = ending.end() if ending else end
    return entities.unescape("".join(parts))


# ---- the template ----

_MASK = (1 << 64) - 1


def _page_tokens(page: Page) -> dict[tuple[int, bool], list[int]]:
    """By token and whether it is a text: occurrences, characters outside and inside links, sum of text hashes, best mark."""
    found: dict[tuple[int, bool], list[int]] = {}
    of = [found.setdefault((t, False), [0, 0, 0, 0, -1]) for t in page.tokens]
    for own, mark in zip(of, page.marks, strict=True):
        own[0] += 1
        own[4] = max(own[4], mark)
    for at, text, linked in page.blocks:
        token = _text_token(page.tokens[at], text)
        found.setdefault((token, True), [0, len(text) - linked, linked, 0, 0])[0] += 1
        above = at
        while above >= 0:
            own = of[above]
            own[1] += len(text) - linked
            own[2] += linked
            own[3] = own[3] + token & _MASK
            above = page.parents[above]
    return found


_TOKEN_COLUMNS = "host string, page long, token long, is_text boolean, n long, plain long, linked long, texts long, mark int, whole long"


def _token_rows(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(10)]
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not html:
                continue
            page = xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass")) - 2**63
            found = _page_tokens(parse(html))
            whole = found[0, False][1]
            for (token, is_text), (n, plain, linked, texts, mark) in found.items():
                for column, value in zip(out, (host, page, token, is_text, n, plain, linked, texts - 2**63, mark, whole), strict=True):
                    column.append(value)
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64), t) if pa.types.is_int64(t) else pa.array(c, t) for c, t in zip(out, types, strict=True)], [c.split()[0] for c in _TOKEN_COLUMNS.split(", ")])


def _sites(pages: DataFrame) -> DataFrame:
    """(host): the hosts that show enough different pages to be a site of their own."""
    shown = pages.where(F.octet_length("html") > 0).groupBy("host").agg(F.bit_or(_residue(F.xxhash64("html"))).alias("differ"))
    return cut(shown.where(F.bit_count("differ") >= MIN_PAGES).select(F.col("host").alias("site")))


def _residue(page):
    """One of 64 bits: pages are told apart by residues of their hash, so a count of different ones is a sum of fixed size, never above the truth."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(page, 8), F.lit(64)).cast("int"))


def template_tokens(pages: DataFrame) -> DataFrame:
    """(site, token, is_text, size, share, linked, same, wide, mark) of the tokens of valid classes, of pages (host, html).

    `site` is the host, or null for the hosts of too few pages; `size` counts the
    tokens of the class; `share` is the token's part of the plain text of the pages
    that it stands in, `linked` the part of its own text that is inside links, `same`
    whether it holds the same text on all of them though the site's pages differ, and
    `wide` whether at least half of the site's pages have it. A text is a token of the template if at least half of the site's pages have it.
    """
    sites = _sites(pages)
    sites = F.broadcast(sites) if sites.count() <= BROADCAST_ROWS else sites
    tokens = pages.mapInArrow(_token_rows, _TOKEN_COLUMNS).join(sites, F.col("host") == F.col("site"), "left")
    low, high = F.pmod("page", F.lit(1 << 31)), F.pmod(F.shiftrightunsigned("page", 32), F.lit(1 << 31))
    sums = [F.sum(c).alias(c) for c in ("n", "plain", "linked", "whole")]
    sums += [F.count("*").alias("pages"), F.sum(low * F.col("n")).alias("v0"), F.sum(high * F.col("n")).alias("v1"), F.min("texts").alias("low"), F.max("texts").alias("high"), F.bit_or(_residue(F.col("page"))).alias("differ"), F.max("mark").alias("mark")]
    vectors = cut(tokens.groupBy("site", "token", "is_text").agg(*sums).where(F.bit_count("differ") >= MIN_PAGES))
    whole = vectors.where((F.col("token") == 0) & ~F.col("is_text")).select(F.col("site").alias("s"), F.col("pages").alias("all_pages"), (F.col("low") != F.col("high")).alias("vary"))
    vectors = vectors.join(whole, F.col("site").eqNullSafe(F.col("s")))
    vectors = vectors.where(F.col("pages") >= F.when(F.col("is_text"), MOST).otherwise(SUPPORT) * F.col("all_pages"))
    tags = F.when(F.col("is_text"), 1).otherwise(2)
    classes = vectors.groupBy("site", "pages", "n", "v0", "v1").agg(F.sum(tags).alias("size"), F.collect_list(F.struct("token", "is_text", "plain", "linked", "whole", "low", "high", "mark", "vary", (F.col("pages") >= MOST * F.col("all_pages")).alias("wide"))).alias("members"))
    valid = classes.where(F.col("size") >= MIN_TOKENS).select("site", "size", F.explode("members").alias("m")).select("site", "size", "m.*")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    text = F.col("plain") + F.col("linked")
    same = F.col("vary") & (F.col("is_text") | ((F.col("low") == F.col("high")) & (text > 0)))
    return valid.select("site", "token", "is_text", "size", part(F.col("plain"), F.col("whole")).alias("share"), part(F.col("linked"), text).alias("linked"), same.alias("same"), "wide", "mark")


ROLES = ("main", "minor", "content", "furniture", "constant")


def template_roles(tokens: DataFrame) -> DataFrame:
    """(site, main, minor, content, furniture, constant): the tokens of each site whose part the template decides.

    minor are articles that are not main; constant are slots of one and the same text on
    half of the site's pages or more, which are no content even inside the main slot.
    """
    article, most = F.col("mark") == 1, ~F.col("is_text") & (F.col("share") >= MOST)
    furniture = ~most & (F.col("same") | (F.col("linked") > MOST))
    constant = ~F.col("is_text") & ~most & ~article & F.col("same") & F.col("wide")
    rules = (article & most, article & ~most, most, furniture, constant)
    return tokens.groupBy("site").agg(*[F.collect_list(F.when(rule, F.col("token"))).alias(name) for name, rule in zip(ROLES, rules, strict=True)])


def main_blocks(page: Page, main: set[int], minor: set[int], content: set[int], furniture: set[int], constant: set[int]) -> list[str]:
    """The texts of a page's main slots, by its site's template; what the template does not know has the part that its name says."""
    slots = main
    if not any(t in main for t in page.tokens):
        slots = {t for t, m in zip(page.tokens, page.marks, strict=True) if m == 1 and t not in minor}
    # 0 outside the main slot, 1 inside, -1 dropped
    state = [0]
    for token, parent, mark in zip(page.tokens[1:], page.parents[1:], page.marks[1:], strict=True):
        part = state[parent]
        if token in slots and (part >= 0 or token in main):
            part = 1
        elif part >= 0 and ((mark < 0 and token not in content) or (part == 0 and token in furniture) or token in constant):
            part = -1
        state.append(part)
    if 1 in state:
        return [text for at, text, _ in page.blocks if state[at] == 1]
    return [text for at, text, _ in page.blocks if state[at] == 0 and _text_token(page.tokens[at], text) not in furniture]


def _text_rows(common: tuple):
    def rows(batches):
        known = {None: [set(x) for x in common]}
        for batch in batches:
            texts = []
            for page, site, *sets in zip(*(batch.column(c).to_pylist() for c in ("__html", "site", *ROLES)), strict=True):
                if site not in known:
                    known = {k: known[k] for k in [None, *known][: KEPT_SITES + 1]} if len(known) > 2 * KEPT_SITES else known
                    known[site] = [set(x) for x in sets]
                texts.append(" ".join(main_blocks(parse(page or ""), *known[site])))
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string())], ["__row", "text"])

    return rows


def extract_text(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Every column of `pages` but the html, then text: the main text of the page, empty if there is none.

    Null and empty html has no text. Pages without a host form one site. Repeated
    pages weigh as often as they stand, but count once where `MIN_PAGES` different
    ones are asked for. An input column `text` is replaced. An empty table gives an
    empty one.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text")]
    rows = pages.select(F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in rest]).alias("__row"), F.col(f"`{html_col}`").alias("__html"), F.coalesce(host_of(F.col(f"`{url_col}`")), F.lit("")).alias("__host"))
    found = cut(template_roles(template_tokens(rows.select(F.col("__host").alias("host"), F.col("__html").alias("html")))))
    # every token of it stands in SUPPORT of the pages: the small hosts' template has at most 1 / SUPPORT of the tokens of a page
    common = found.where("site is null").select(*ROLES).first() or ([],) * len(ROLES)
    own = found.where("site is not null")
    n, tokens = own.agg(F.count("*"), F.coalesce(F.sum(sum(F.size(c) for c in ROLES)), F.lit(0))).first()
    own = F.broadcast(own) if n <= BROADCAST_ROWS and tokens <= BROADCAST_TOKENS else own
    out = rows.join(own, F.col("__host") == F.col("site"), "left").select("__row", "__html", "site", *ROLES)
    out = out.mapInArrow(_text_rows(tuple(common)), f"__row {rows.schema['__row'].dataType.simpleString()}, text string")
    return out.select(*[F.col(f"__row.`{c}`") for c in rest], "text")
