"""Pieces of DuckDB SQL that oracles share."""

from __future__ import annotations

from loomdex.functions import text as T


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def ascii_lower(column: str) -> str:
    return f"translate({column}, '{T.UPPER}', '{T.LOWER}')"


def replace_all(column: str, pairs) -> str:
    for old, new in pairs:
        column = f"replace({column}, {literal(old)}, {literal(new)})"
    return column


def literal(value: str) -> str:
    """A string literal; control characters by number."""
    parts, plain = [], ""
    for c in value:
        if ord(c) < 32:
            parts += [quoted(plain)] * bool(plain) + [f"chr({ord(c)})"]
            plain = ""
        else:
            plain += c
    parts += [quoted(plain)] * bool(plain or not parts)
    return " || ".join(parts) if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def gsub(column: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({column}, {quoted(pattern)}, {literal(new)}, 'g')"


def strip(column: str) -> str:
    return gsub(column, r"^\s+|\s+\z")


def collapse(column: str) -> str:
    return strip(gsub(column, r"\s+", " "))


def contains_any(column: str, words) -> str:
    return f"list_bool_or(list_transform({values(words)}, lambda w: contains({column}, w)))"


def tokens(column: str) -> str:
    return rf"list_filter(string_split_regex({ascii_lower(column)}, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def query_terms(column: str) -> str:
    trimmed = rf"list_transform(string_split_regex({column}, '[^\p{{L}}\p{{N}}''-]+'), lambda t: regexp_replace(t, '^[''-]+|[''-]+\z', '', 'g'))"
    return f"list_filter({trimmed}, lambda t: strlen(t) > 1 AND NOT list_contains({values(T.STOPWORDS)}, {ascii_lower('t')}))[1:32]"


def snippet(column: str, n: int) -> str:
    flat = collapse(gsub(column, T.CONTROLS, " "))
    return f"CASE WHEN length({flat}) > {n} THEN regexp_replace(left({flat}, {n}), '\\s+\\z', '') || '…' ELSE {flat} END"


def truncate_marked(column: str, size) -> str:
    return f"CASE WHEN length({column}) <= {size} THEN {column} WHEN {size} <= {len(T.TRUNCATED)} THEN left({column}, {size}) ELSE left({column}, ({size}) - {len(T.TRUNCATED)}) || '{T.TRUNCATED}' END"


def search_query(column: str) -> str:
    endings = "|".join(sorted(T.SEARCH_SUFFIXES, key=len, reverse=True))
    return strip(replace_all(strip(f"regexp_replace({strip(column)}, '(?i)(?:{endings})\\z', '')"), [("prics", "price"), ("serch", "search")]))
