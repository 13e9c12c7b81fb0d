"""Queries over the scalar text functions, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.plans import sql as S
from loomdex.plans.register import register
from loomdex.sources.tables import table

QUERIES, SQL, query = register()


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def tokenize(spark, sf_dir):
    tokens = T.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


@query(f"SELECT item_id, coalesce(array_to_string(list_transform({S.query_terms('text')}, lambda t: '\"' || t || '\"'), ' OR '), '') AS terms FROM benchmark")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.any_term_query(F.col("text")).alias("terms"))


# pieces end at every . ! ? before white space; a piece that ends in an abbreviation or an initial goes on
_SHORT = rf"(^|\s)[^\p{{L}}\p{{N}}\s.]{{0,3}}((?i:{'|'.join(a.replace('.', chr(92) + '.') for a in T.ABBREVIATIONS)})|\p{{Lu}})\.[\"'')]?$"
_PIECES = r"""SELECT doc_id, generate_subscripts(x, 1) AS o, unnest(x) AS piece FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]["'')]?)(\s|\z)', '\1' || chr(30) || '\2', 'g'), chr(30)) AS x FROM documents)"""


@query(
    f"""WITH p AS ({_PIECES}), m AS (SELECT *, coalesce(regexp_matches(lag(piece) OVER (PARTITION BY doc_id ORDER BY o), '{_SHORT}'), false) AS goes_on FROM p),
    n AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY o) AS s FROM m), t AS (SELECT doc_id, s, {S.strip("string_agg(piece, '' ORDER BY o)")} AS sentence FROM n GROUP BY doc_id, s)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS pos, sentence FROM t WHERE sentence <> ''"""
)
def split_sentences(spark, sf_dir):
    sentences = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))
    return sentences.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 8 AS has_content FROM documents")
def has_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_content(F.col("text")).alias("has_content"))


_NEUTRAL = S.strip(S.gsub(S.replace_all(S.gsub("{c}", T.INVISIBLE), [("<<<SOURCE", "<<< SOURCE"), ("<<<END", "<<< END"), (">>>", "> >>")]), r"\n([^\S\n]*)\n(?:[^\S\n]*\n)+", "\n\\1\n"))


@query(f"SELECT 'd' || doc_id AS id, md5({_NEUTRAL.replace('{c}', 'text')}) AS neutral_md5 FROM documents UNION ALL SELECT 'p' || page_id, md5({_NEUTRAL.replace('{c}', 'html')}) FROM pages")
def neutralize(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("t"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("t"))
    return documents.union(pages).select("id", F.md5(T.neutralize(F.col("t"))).alias("neutral_md5"))


@query(f"SELECT page_id, {S.strip(S.replace_all('left(' + S.gsub('url', T.CONTROLS) + ', 120)', [('>>>', ''), ('<<<', '')]))} AS meta FROM pages")
def sanitize_meta(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.sanitize_meta(F.col("url")).alias("meta"))


@query(f"SELECT doc_id, {S.snippet('text', 180)} AS citation, {S.snippet('text', 80)} AS session, {S.snippet('text', 90)} AS mail FROM documents")
def snippets(spark, sf_dir):
    cut = lambda n: T.snippet(F.col("text"), n)
    return table(spark, sf_dir, "documents").select("doc_id", cut(180).alias("citation"), cut(80).alias("session"), cut(90).alias("mail"))


@query(f"SELECT conv_id, turn, {S.truncate_marked('text', 200)} AS long_cut, {S.truncate_marked('text', 10)} AS short_cut FROM conversations")
def truncate_marked(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.truncate_marked(text, 200).alias("long_cut"), T.truncate_marked(text, 10).alias("short_cut"))


@query(
    r"""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN strlen(b) > 90 THEN regexp_replace(b, '\s+\z', '') ELSE left(text, 120) END AS cut
    FROM (SELECT doc_id, text, regexp_extract(left(text, 120), '(?s)^(.*)\s\S*\z', 1) AS b FROM documents)"""
)
def truncate_at_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_at_word(F.col("text"), 120).alias("cut"))


@query(
    rf"""WITH f AS (SELECT conv_id, replace({S.strip('arg_min(text, turn)')}, chr(10), ' ') AS t FROM conversations GROUP BY conv_id),
    g AS (SELECT *, regexp_extract(left(t, 36), '(?s)^(.*) [^ ]*\z', 1) AS b FROM f)
    SELECT conv_id, CASE WHEN length(t) <= 36 THEN t WHEN strlen(b) > 10 THEN b ELSE left(t, 36) END AS title FROM g"""
)
def auto_title(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", T.auto_title(F.col("text")).alias("title"))


def _mail_sql(column: str) -> str:
    seen = S.gsub(column, T.MAIL_INVISIBLE)
    for tag in ("script", "style"):
        seen = S.gsub(seen, rf"(?is)<{tag}.*?(?:</{tag}>|\z)")
    seen = S.replace_all(seen, [("<br>", "\n"), ("<br/>", "\n"), ("<br />", "\n"), ("</p>", "\n\n"), ("</div>", "\n"), ("</tr>", "\n"), ("</li>", "\n")])
    seen = S.replace_all(S.replace_all(S.gsub(seen, r"<[^>]*(?:>|\z)"), [(">", "")]), T.MAIL_ENTITIES)
    seen = S.gsub(S.gsub(seen, r"[^\S\n]*\n[^\S\n]*", "\n"), r"\n{3,}", "\x01")
    return S.strip(S.replace_all(seen, [("\n\n", "\n"), ("\x01", "\n\n")]))


@query(f"SELECT page_id, md5(t) AS body_md5, length(t) AS n_chars FROM (SELECT page_id, {_mail_sql('html')} AS t FROM pages)")
def mail_sanitize(spark, sf_dir):
    body = table(spark, sf_dir, "pages").select("page_id", T.mail_sanitize(F.col("html")).alias("t"))
    return body.select("page_id", F.md5("t").alias("body_md5"), F.length("t").cast("long").alias("n_chars"))


def _plain_sql(column: str) -> str:
    plain = S.gsub(column, r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*(?:\n|\z)|\z)")
    plain = S.gsub(S.gsub(plain, r"(?m)^[ \t]*#*[ \t]*"), r"\[([^\]\n]*)\]\([^)\n]*\)?", "\\1")
    plain = S.gsub(S.gsub(plain, r"\[[^\]\n]*(?:chunk:|citation:)[^\]\n]*\]"), r"\[([^\]\n]*)\]", "\\1")
    return S.collapse(S.gsub(plain, r"[`*_]"))


@query(f"SELECT conv_id, turn, {_plain_sql('text')} AS plain FROM conversations")
def markdown_to_plain(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.markdown_to_plain(F.col("text")).alias("plain"))


_ANNOTATION = r"\[[^\[\]()]*\]|\([^\[\]()]*\)"


@query(
    rf"""SELECT doc_id, md5(t) AS spoken_md5, NOT regexp_matches(t, '[\p{{L}}\p{{N}}]') AS empty
    FROM (SELECT doc_id, {S.collapse(S.gsub(S.gsub(S.gsub('text', _ANNOTATION), _ANNOTATION), _ANNOTATION))} AS t FROM documents)"""
)
def strip_annotations(spark, sf_dir):
    spoken = table(spark, sf_dir, "documents").select("doc_id", T.strip_annotations(F.col("text")).alias("t"))
    return spoken.select("doc_id", F.md5("t").alias("spoken_md5"), (~F.col("t").rlike(r"[\p{L}\p{N}]")).alias("empty"))


def _starts_sql(raw: str, lower: str) -> str:
    return ", ".join(f"CASE WHEN starts_with({lower}, '{p}') THEN nullif({S.search_query(f'substr({raw}, {len(p) + 1})')}, '') END" for p in T.SEARCH_PREFIXES)


@query(
    f"""WITH r AS (SELECT conv_id, turn, {S.strip('t')} AS raw FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Search for ' || text || ' please' WHEN 1 THEN text || ' Who is' WHEN 2 THEN text ELSE '[web_search] ' || text END AS t FROM conversations)),
    l AS (SELECT *, {S.ascii_lower('raw')} AS low FROM r)
    SELECT conv_id, turn, CASE WHEN starts_with(raw, '[web_search]') THEN nullif({S.search_query("regexp_replace(raw, '^(?:\\[web_search\\])+', '')")}, '')
    ELSE coalesce({_starts_sql('raw', 'low')}, CASE WHEN {S.contains_any('low', T.LIVE_WORDS)} THEN nullif({S.search_query('raw')}, '') END) END AS web_query FROM l"""
)
def web_intent(spark, sf_dir):
    text, turn = F.col("text"), F.col("turn") % 4
    asked = F.when(turn == 0, F.concat(F.lit("Search for "), text, F.lit(" please"))).when(turn == 1, F.concat(text, F.lit(" Who is"))).when(turn == 2, text).otherwise(F.concat(F.lit("[web_search] "), text))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.web_intent(asked).alias("web_query"))


@query(
    f"""WITH m AS (SELECT conv_id, turn, ['developer', 'researcher', 'creative', 'general'][1 + conv_id % 4] AS persona, CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN 'Write code: ' || text ELSE text END AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN persona = 'developer' THEN 'coder' WHEN persona = 'researcher' THEN 'reasoning'
    WHEN (contains(t, '```') AND {S.contains_any(S.ascii_lower('t'), T.CODE_WORDS)}) OR regexp_matches({S.ascii_lower('t')}, '^(?:{'|'.join(T.CODE_PREFIXES)})') THEN 'coder' ELSE 'general' END AS slot FROM m"""
)
def route_message(spark, sf_dir):
    persona = F.element_at(T.lit_array(["developer", "researcher", "creative", "general"]), (F.col("conv_id") % 4 + 1).cast("int"))
    text = F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), F.concat(F.lit("Write code: "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.route_message(persona, text).alias("slot"))


@query(f"SELECT item_id, {S.contains_any('lower(text)', T.DOCUMENT_WORDS)} AS asks_documents FROM benchmark")
def document_intent(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.document_intent(F.col("text")).alias("asks_documents"))


@query("SELECT page_id, left(sha256(url), 32) AS document_key FROM pages")
def document_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.document_key(F.col("url")).alias("document_key"))


_ANSWERS = "SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' [' || (turn + 2) || '] and [1][' || (turn + 2) || '] [x] [12' WHEN turn % 3 = 1 THEN ' I could not find it' ELSE '' END AS a FROM conversations WHERE role = 'assistant'"


def answers(spark, sf_dir):
    """Assistant texts, some with markers and some refusals appended by turn."""
    turn = F.col("turn")
    marked = F.concat(F.lit(" ["), turn + 2, F.lit("] and [1]["), turn + 2, F.lit("] [x] [12"))
    extra = F.when(turn % 3 == 0, marked).when(turn % 3 == 1, F.lit(" I could not find it")).otherwise(F.lit(""))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat("text", extra).alias("a"))


@query(
    rf"""SELECT conv_id, turn, array_to_string(m, ',') AS markers, {S.strip('a')} <> '' AND len(m) = 0 AND NOT contains(lower(a), 'could not find') AS uncited
    FROM (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(a, '\[(\d{{1,9}})\]', 1), lambda n: n::INT))) AS m FROM ({_ANSWERS}))"""
)
def cited_markers(spark, sf_dir):
    a = F.col("a")
    return answers(spark, sf_dir).select("conv_id", "turn", F.array_join(T.cited_markers(a).cast("array<string>"), ",").alias("markers"), T.uncited_claim(a).alias("uncited"))


@query(
    """SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'Today' WHEN ts >= TIMESTAMP '2024-01-19' THEN 'Yesterday' WHEN ts >= TIMESTAMP '2024-01-13' THEN 'Previous 7 Days' ELSE 'Older' END AS bucket
    FROM events WHERE contains(lower(event_type), 'click') OR contains(lower(props), '7')"""
)
def session_bucket(spark, sf_dir):
    now = F.lit("2024-01-20 15:30:00").cast("timestamp_ntz")
    events = table(spark, sf_dir, "events").where(F.lower("event_type").contains("click") | F.lower("props").contains("7"))
    return events.select("event_id", T.session_bucket(F.col("ts"), now).alias("bucket"))


@query("SELECT event_id, 'xlsx' AS type, (props->>'k')::BIGINT AS k FROM events WHERE event_id % 5 <> 0")
def extract_spec_json(spark, sf_dir):
    body = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.col("props"))
    text = F.concat(F.lit("Here it is:\n```xlsx\n"), body, F.lit("\n```\nDone"))
    found = table(spark, sf_dir, "events").select("event_id", T.spec_json(text).alias("s")).where("s is not null")
    return found.select("event_id", "s.type", F.get_json_object("s.spec", "$.k").cast("long").alias("k"))
