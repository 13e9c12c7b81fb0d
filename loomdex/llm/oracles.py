"""DuckDB SQL for the queries that SQL expresses at reasonable cost.

The others have tests against brute force: fingerprints and hash orders need XXH64,
language models and priors are trained, neighbours are approximate.
"""

from __future__ import annotations

from .url_filter import RULES, TRACKING

_HOST = r"coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = r"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _rule(column: int) -> str:
    cases = []
    for name, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        host, _, start = name.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{start}') THEN '{(name, verdict)[column]}'")
    return f"CASE {' '.join(cases)} END"


OP3 = rf"""WITH p AS (SELECT page_id, url, {_HOST.format(u='url')} AS host, {_PATH.format(u='url')} AS path FROM pages),
q AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '')
  || regexp_replace(regexp_replace(regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1), '{TRACKING}', '', 'g'), '^&', '?') END AS k, {_rule(0)} AS rule, {_rule(1)} AS own FROM p),
l AS (SELECT DISTINCT k FROM q WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.') AND k IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN k IN (FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM q"""


def _escaped(column: str, role: bool = False) -> str:
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), *((("|", "&#124;"),) if role else ())):
        column = f"replace({column}, '{char}', '{reference}')"
    return column


OP5 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length({_escaped('role', True)}) + length({_escaped('text')}) + 13)::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t"""

_SPACE = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP9 = f"""WITH d AS (SELECT doc_id, {_SPACE} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13), x AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h), r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN f USING (h) WHERE first < doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE coalesce(k, []) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN (SELECT doc_id, list(v ORDER BY p) AS k FROM (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN r USING (doc_id, p) GROUP BY doc_id) USING (doc_id)"""

_LOWER = r"translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP10 = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ALNUM} AS w FROM benchmark),
p AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT doc_id, n, i, item FROM x JOIN p USING (n, phrase)), c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

_KEY = r"translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
k AS (SELECT doc_id, ls, list_transform(ls, lambda l: {_KEY}) AS ks FROM d),
r AS (SELECT k FROM (SELECT doc_id, unnest(list_distinct(ks)) AS k FROM k) WHERE k <> '' GROUP BY k HAVING count(*) >= 10),
x AS (SELECT doc_id, unnest(ls) AS l, unnest(ks) AS k, generate_subscripts(ls, 1) AS i FROM k),
s AS (SELECT doc_id, count(*) AS n_kept, string_agg(l, chr(10) ORDER BY i) AS kept FROM x ANTI JOIN r USING (k) GROUP BY doc_id)
SELECT d.doc_id, len(ls) AS n_lines, len(ls) - coalesce(n_kept, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""

SQL = {"op3_url_filter": OP3, "op5_chat_format": OP5, "op9_substring_dedup": OP9, "op10_decontamination": OP10, "op11_line_dedup": OP11}
