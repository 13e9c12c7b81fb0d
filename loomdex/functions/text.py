"""Scalar text functions as Column expressions: no Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words that queries leave out.
STOPWORDS = ["the", "a", "an", "of", "to", "in", "is", "it", "and", "or", "for", "on", "at", "by", "be", "as", "that", "this", "with", "from", "was", "are"]
# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "etc", "e.g", "i.e", "vs", "fig", "no", "vol", "pp", "al", "inc", "ltd", "co", "approx", "dept", "est"]
# Substrings that ask for documents.
DOCUMENT_WORDS = [
    "document", "documents", "doc", "docs", "pdf", "file", "files", "library", "upload", "uploaded", "attachment", "summarize", "summarise", "summary", "overview", "review", "takeaway", "takeaways",
    "paper", "report", "spreadsheet", "contract", "agreement", "handbook", "policy", "notes", "what does this say", "what does it say", "what is this about", "what is in this", "explain this",
    "read this", "tell me about this", "key points", "main points", "findings", "table", "section",
]
# Endings that are no part of a search.
SEARCH_SUFFIXES = [
    " and make a pdf", " and make pdf", " and make a pfd", " and make pfd", " and create a pdf", " and create pdf", " and generate a pdf", " and generate pdf", " and export to pdf", " and export as pdf",
    " and make an excel sheet", " and make an excel", " and make excel sheet", " and make excel", " and create excel", " and export to excel", " and make a word doc", " and make a word document",
    " and make word document", " and make word doc", " and make docx", " and create a docx", " and create docx", " and write a report", " and write report", " and summarize", " make a pdf", " make pdf",
    " make a pfd", " make pfd", " in a pdf report", " in a pdf", " in pdf format", " in pdf", " as a pdf", " as pdf", " to a pdf", " to pdf", " in an excel sheet", " in excel", " as an excel sheet",
    " as excel", " in a table", " in table format", " as a table", " please",
]
# Commands that start a search.
SEARCH_PREFIXES = [
    "search google for ", "search the web for ", "search web for ", "search internet for ", "search for ", "search ", "serch google for ", "serch the web for ", "serch web for ", "serch for ", "serch ",
    "google ", "look up ", "lookup ", "find online ", "browse ",
]
# Words that ask for live information.
LIVE_WORDS = [
    "stock price", "stock prics", "share price", "market cap", "weather in", "weather of", "weather today", "latest news", "today news", "todays news", "who is", "who won", "match score", "live score",
    "cricket score", "current price of", "price of",
]
# Words that make a fenced block a code request, and openings of code requests.
CODE_WORDS = ["code", "error", "bug", "fix", "compile", "stacktrace", "stack trace", "refactor"]
CODE_PREFIXES = [
    "write code", "write a script", "write a function", "write a python script", "write a rust function", "write a javascript function", "implement a function", "create a function", "refactor this code",
    "debug this code", "fix this code", "fix the bug", "review this code",
]
#: Controls but new line and tab, zero-width, bidi and other invisible characters.
INVISIBLE = r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{FEFF}\x{180E}\x{AD}]"
MAIL_INVISIBLE = r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{AD}\x{34F}\x{180E}]"
CONTROLS = r"[\x00-\x1F\x7F-\x{9F}]"
# Character references that mail and pages decode, in order of replacement.
MAIL_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")]
PAGE_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]
TRUNCATED = " … (truncated)"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def replace_all(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def ascii_lower(text: Column) -> Column:
    """A-Z only: full lower-casing may change the number of characters."""
    return F.translate(text, UPPER, LOWER)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def contains_any(text: Column, words) -> Column:
    """One alternation instead of a test a word."""
    escaped = ["".join("\\" + c if c in r".+*?()[]{}|^$\-" else c for c in w) for w in words]
    return text.rlike("|".join(escaped))


def tokenize(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(text: Column) -> Column:
    """At most 32 terms that are longer than a byte and no stopwords."""
    terms = F.transform(F.split(text, r"[^\p{L}\p{N}'-]+"), lambda t: F.regexp_replace(t, r"^['-]+|['-]+\z", ""))
    stop = lit_array(STOPWORDS)
    return F.slice(F.filter(terms, lambda t: (F.octet_length(t) > 1) & ~F.array_contains(stop, ascii_lower(t))), 1, 32)


def any_term_query(text: Column) -> Column:
    return F.array_join(F.transform(query_terms(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def split_sentences(text: Column) -> Column:
    """Ends at . ! ? before white space, a closing quote or bracket between; not after abbreviations or one capital."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    guard = rf"(?<!(?:^|\s)[^\p{{L}}\p{{N}}\s.]{{0,3}}(?i:{short}))(?<!(?:^|\s)[^\p{{L}}\p{{N}}\s.]{{0,3}}\p{{Lu}})"
    marked = F.regexp_replace(text, rf"""((?:[!?]|{guard}\.)(?=["')]?(?:\s|\z))["')]*)""", "$1\x1e")
    return F.filter(F.transform(F.split(marked, "\x1e"), strip), lambda s: s != "")


def has_content(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) >= 8


def neutralize(text: Column) -> Column:
    """Text that cannot close its own fence and hides nothing from a reader."""
    shown = F.regexp_replace(text, INVISIBLE, "")
    shown = replace_all(shown, [("<<<SOURCE", "<<< SOURCE"), ("<<<END", "<<< END"), (">>>", "> >>")])
    return strip(F.regexp_replace(shown, r"\n([^\S\n]*)\n(?:[^\S\n]*\n)+", "\n$1\n"))


def sanitize_meta(text: Column) -> Column:
    return strip(replace_all(F.left(F.regexp_replace(text, CONTROLS, ""), F.lit(120)), [(">>>", ""), ("<<<", "")]))


def snippet(text: Column, n: int) -> Column:
    flat = collapse(F.regexp_replace(text, CONTROLS, " "))
    return F.when(F.length(flat) > n, F.concat(F.regexp_replace(F.left(flat, F.lit(n)), r"\s+\z", ""), F.lit("…"))).otherwise(flat)


def truncate_marked(text: Column, size: Column | int) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    marker = len(TRUNCATED)
    return F.when(F.length(text) <= size, text).when(size <= marker, F.left(text, size)).otherwise(F.concat(F.left(text, size - marker), F.lit(TRUNCATED)))


def truncate_at_word(text: Column, size: int) -> Column:
    """Cut at the last white space if that leaves over three quarters (its byte offset counts)."""
    cut = F.left(text, F.lit(size))
    before = F.regexp_extract(cut, r"(?s)^(.*)\s\S*\z", 1)
    return F.when(F.length(text) <= size, text).when(F.octet_length(before) > size * 3 // 4, F.regexp_replace(before, r"\s+\z", "")).otherwise(cut)


def auto_title(text: Column) -> Column:
    clean = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    cut = F.left(clean, F.lit(36))
    before = F.regexp_extract(cut, r"(?s)^(.*) [^ ]*\z", 1)
    return F.when(F.length(clean) <= 36, clean).when(F.octet_length(before) > 10, before).otherwise(cut)


def mail_sanitize(text: Column) -> Column:
    """Visible text of a mail body: no markup, at most one blank line."""
    seen = F.regexp_replace(text, MAIL_INVISIBLE, "")
    for tag in ("script", "style"):
        seen = F.regexp_replace(seen, rf"(?is)<{tag}.*?(?:</{tag}>|\z)", "")
    seen = replace_all(seen, [("<br>", "\n"), ("<br/>", "\n"), ("<br />", "\n"), ("</p>", "\n\n"), ("</div>", "\n"), ("</tr>", "\n"), ("</li>", "\n")])
    seen = F.replace(F.regexp_replace(seen, r"<[^>]*(?:>|\z)", ""), F.lit(">"), F.lit(""))
    seen = F.regexp_replace(replace_all(seen, MAIL_ENTITIES), r"[^\S\n]*\n[^\S\n]*", "\n")
    # one or no blank line joins two lines, more leave one blank line
    seen = replace_all(F.regexp_replace(seen, r"\n{3,}", "\x01"), [("\n\n", "\n"), ("\x01", "\n\n")])
    return strip(seen)


def markdown_to_plain(text: Column) -> Column:
    """Speakable text: no fenced code, headings' signs, emphasis or citations; links become their labels."""
    plain = F.regexp_replace(text, r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*(?:\n|\z)|\z)", "")
    plain = F.regexp_replace(plain, r"(?m)^[ \t]*#*[ \t]*", "")
    plain = F.regexp_replace(plain, r"\[([^\]\n]*)\]\([^)\n]*\)?", "$1")
    plain = F.regexp_replace(plain, r"\[[^\]\n]*(?:chunk:|citation:)[^\]\n]*\]", "")
    plain = F.regexp_replace(plain, r"\[([^\]\n]*)\]", "$1")
    return collapse(F.regexp_replace(plain, r"[`*_]", ""))


def strip_annotations(text: Column) -> Column:
    """Without bracketed spans, nested up to three deep."""
    for _ in range(3):
        text = F.regexp_replace(text, r"\[[^\[\]()]*\]|\([^\[\]()]*\)", "")
    return collapse(text)


def search_query(text: Column) -> Column:
    """A search without one noise ending and two common slips."""
    endings = "|".join(sorted(SEARCH_SUFFIXES, key=len, reverse=True))
    return strip(replace_all(strip(F.regexp_replace(strip(text), rf"(?i)(?:{endings})\z", "")), [("prics", "price"), ("serch", "search")]))


def web_intent(text: Column) -> Column:
    """The query of a message that wants a web search, else null."""
    raw = strip(text)
    lower = ascii_lower(raw)
    filled = lambda c: F.when(c != "", c)
    tagged = raw.startswith("[web_search]")
    starts = [F.when(lower.startswith(p), filled(search_query(F.substr(raw, F.lit(len(p) + 1))))) for p in SEARCH_PREFIXES]
    live = F.when(contains_any(lower, LIVE_WORDS), filled(search_query(raw)))
    return F.when(tagged, filled(search_query(F.regexp_replace(raw, r"^(?:\[web_search\])+", "")))).otherwise(F.coalesce(*starts, live))


def requests_code(text: Column) -> Column:
    lower = ascii_lower(text)
    fenced = text.contains("```") & contains_any(lower, CODE_WORDS)
    return fenced | lower.rlike("^(?:" + "|".join(CODE_PREFIXES) + ")")


def route_message(persona: Column, text: Column) -> Column:
    return F.when(persona == "developer", "coder").when(persona == "researcher", "reasoning").when(requests_code(text), "coder").otherwise("general")


def document_intent(text: Column) -> Column:
    """Substrings of the text lower-cased by Unicode rules, so that "profile" asks for a file."""
    return contains_any(F.lower(text), DOCUMENT_WORDS)


def document_key(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(32))


def cited_markers(answer: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), 1), lambda n: n.cast("int"))))


def uncited_claim(answer: Column) -> Column:
    return (strip(answer) != "") & (F.size(cited_markers(answer)) == 0) & ~F.lower(answer).contains("could not find")


def session_bucket(at: Column, now: Column) -> Column:
    today = F.date_trunc("day", now)
    return F.when(at >= today, "Today").when(at >= today - F.expr("INTERVAL 1 DAY"), "Yesterday").when(at >= today - F.expr("INTERVAL 7 DAY"), "Previous 7 Days").otherwise("Older")


def spec_json(text: Column) -> Column:
    """(type, spec) of the first fenced block or document tag with valid JSON; null if there is none."""
    kinds = "xlsx|docx|pdf"

    def found(pattern: str) -> Column:
        kind, body = F.lower(F.regexp_extract(text, pattern, 1)), strip(F.regexp_extract(text, pattern, 2))
        spec = F.try_parse_json(body)
        return F.when((kind != "") & spec.isNotNull(), F.struct(kind.alias("type"), F.to_json(spec).alias("spec")))

    return F.coalesce(found(rf"(?is)```(?:[a-z]+-doc:)?({kinds})\s*\n?(.*?)\n?```"), found(rf"""(?is)<[a-z]+_document\s+type=["']({kinds})["'][^>]*>(.*?)</[a-z]+_document>"""))
