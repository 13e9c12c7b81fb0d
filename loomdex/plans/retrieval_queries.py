"""Queries of vectors and retrieval with their oracles: benchmark items ask, documents answer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.operators import index as X
from loomdex.operators import retrieval as R
from loomdex.operators import vectors as V
from loomdex.plans import sql as S
from loomdex.plans.register import register
from loomdex.plans.text_queries import _ANSWERS, _NEUTRAL, answers
from loomdex.shared import cut, exists
from loomdex.sources.tables import table, version

QUERIES, SQL, query = register()


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_INDEXES: dict[tuple, X.Index] = {}


def index(spark, sf_dir):
    """The index of the documents of a folder: built and written by the first query of a session that asks for it, and again once its files have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir, "documents"))
    if key not in _INDEXES or not exists(spark, _INDEXES[key].path):
        _INDEXES[key] = X.build_index(table(spark, sf_dir, "documents"))
    return _INDEXES[key]


def lexical(spark, sf_dir, k=R.CANDIDATES):
    return R.bm25_top_k(questions(spark, sf_dir), index(spark, sf_dir), k)


def dense(spark, sf_dir, k=R.CANDIDATES):
    asked = V.hash_embed(questions(spark, sf_dir), "query_id", "text").withColumnRenamed("id", "query_id")
    return V.dense_top_k(index(spark, sf_dir).vectors, asked, k)


def _bm25_sql(name: str, asked: str, k: int, source: str = "SELECT doc_id AS id, text FROM documents") -> str:
    return f"""{name} AS (WITH w AS (SELECT id, {S.tokens('text')} AS t FROM ({source})), s AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS mean FROM w),
    p AS (SELECT token, id, n_len, count(*) AS tf FROM (SELECT id, len(t) AS n_len, unnest(t) AS token FROM w) GROUP BY ALL),
    f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
    a AS (SELECT query_id, token, count(*) AS times FROM ({asked}) GROUP BY ALL),
    r AS (SELECT query_id, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * n_len / mean))), 9) AS score FROM a JOIN p USING (token) JOIN f USING (token), s GROUP BY ALL)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM r WHERE score > 0 QUALIFY rank < {k})"""


_ALL_WORDS = f"SELECT item_id AS query_id, unnest({S.tokens('text')}) AS token FROM benchmark"
_TERMS = f"SELECT query_id, unnest({S.tokens('term')}) AS token FROM (SELECT item_id AS query_id, unnest({S.query_terms('text')}) AS term FROM benchmark)"


def _embed_sql(name: str, source: str) -> str:
    """(id, v) of rows (id, text), the hashed embedding in 64 slots."""
    slot = "('0x' || substr(md5(token), {}, 8))::BIGINT % 64"
    return f"""{name} AS (WITH c AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest({S.tokens('text')}) AS token FROM ({source})) GROUP BY ALL),
    w AS (SELECT id, slot, sum(w) AS w FROM (SELECT id, {slot.format(1)} AS slot, n * 1.0::DOUBLE AS w FROM c UNION ALL SELECT id, {slot.format(9)}, n * 0.5::DOUBLE FROM c) GROUP BY ALL),
    g AS (SELECT i.id, r.slot, coalesce(w.w, 0.0) AS w FROM (SELECT DISTINCT id FROM w) i CROSS JOIN (SELECT unnest(range(64)) AS slot) r LEFT JOIN w ON w.id = i.id AND w.slot = r.slot),
    d AS (SELECT id, list(w ORDER BY slot) AS v, sqrt(sum(w * w)) AS size FROM g GROUP BY id) SELECT id, list_transform(v, lambda x: x / size) AS v FROM d)"""


_DENSE = (
    _embed_sql("ed", "SELECT doc_id AS id, text FROM documents")
    + ", "
    + _embed_sql("eq", "SELECT item_id AS id, text FROM benchmark")
    + f""", dense AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank
    FROM (SELECT eq.id AS query_id, ed.id, round(list_dot_product(eq.v, ed.v), 9) AS score FROM eq, ed) WHERE score > 0 QUALIFY rank < {R.CANDIDATES})"""
)
_LISTS = _bm25_sql("lexical", _ALL_WORDS, R.CANDIDATES) + ", " + _DENSE


def _dense_first_sql(limit: int, reserved: int, fill: bool = True) -> str:
    return f"""m AS (SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.id, l.id) AS id, d.rank AS dr, l.rank AS lr, d.score AS ds, l.score AS ls FROM dense d FULL JOIN lexical l ON d.query_id = l.query_id AND d.id = l.id),
    h AS (SELECT *, coalesce(dr < {limit - reserved}, false) AS head FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, head ORDER BY lr NULLS LAST) AS lp FROM h),
    k AS (SELECT *, CASE WHEN head THEN 0 WHEN lr IS NOT NULL AND lp <= {reserved} THEN 1 WHEN dr IS NOT NULL THEN 2 ELSE 3 END AS kind FROM p),
    ranked AS (SELECT query_id, id, CASE WHEN kind IN (0, 2) THEN ds ELSE ls END AS score, array_to_string(list_filter([CASE WHEN dr IS NOT NULL THEN 'dense' END, CASE WHEN lr IS NOT NULL THEN 'lexical' END], lambda s: s IS NOT NULL), ',') AS sources,
    row_number() OVER (PARTITION BY query_id ORDER BY kind, CASE WHEN kind IN (0, 2) THEN dr ELSE lr END, id) - 1 AS rank FROM k WHERE {str(fill).lower()} OR kind < 3 QUALIFY rank < {limit})"""


_TOPS = "tops AS (SELECT q.query_id, coalesce(l.score, 0.0) AS top_bm25, coalesce(d.score, 0.0) AS top_cosine FROM (SELECT item_id AS query_id FROM benchmark) q LEFT JOIN (FROM lexical WHERE rank = 0) l USING (query_id) LEFT JOIN (FROM dense WHERE rank = 0) d ON d.query_id = q.query_id)"
_HYBRID = f"{_LISTS}, {_dense_first_sql(8, 1)}, {_TOPS}, hits AS (SELECT r.*, t.top_bm25, t.top_cosine, o.source AS name, o.text FROM ranked r JOIN documents o ON o.doc_id = r.id JOIN tops t USING (query_id))"


def hybrid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), "text")
    return R.hybrid_search(dense(spark, sf_dir), lexical(spark, sf_dir), docs)


# ---- vectors ----

_V = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total, round(v[1] / n, 6) AS first FROM (SELECT vec_id, {_V} AS v, sqrt(list_dot_product({_V}, {_V})) AS n FROM embeddings)")
def l2_normalize(spark, sf_dir):
    unit = V.l2_normalize(V.as_double(F.transform("embedding", lambda x: x * 3)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("u"))
    return rows.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.col("u")[0], 6).alias("first"))


@query(f"WITH v AS (SELECT vec_id, {_V} AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("a"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return rows.join(other, "vec_id").select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("SELECT vec_id % 7 NOT IN (0, 3) AS valid, count(*) AS n FROM embeddings GROUP BY ALL")
def vector_validate(spark, sf_dir):
    bad = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 5)).when(F.col("vec_id") % 7 == 3, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", bad.alias("embedding"))
    return V.validate(rows, "embedding", 64).groupBy("valid").agg(F.count("*").alias("n"))


@query(f"WITH {_embed_sql('e', 'SELECT doc_id AS id, text FROM documents')} SELECT id, round(list_sum(v), 6) AS total, round(list_max(v), 6) AS top, list_position(v, list_max(v))::BIGINT AS slot FROM e")
def hash_embed(spark, sf_dir):
    rows = V.hash_embed(table(spark, sf_dir, "documents"), "doc_id", "text")
    top = F.array_max("vector")
    return rows.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(top, 6).alias("top"), F.array_position("vector", top).cast("long").alias("slot"))


#: Pieces of a text: its lines, longer ones cut, packed in order; a mark stands between pieces.
_PIECES = r"""SELECT id, unnest(list_filter(string_split(CASE WHEN length(text) <= 1000 THEN text ELSE list_reduce(flatten(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(l) > 1000 THEN regexp_extract_all(l, '(?s)\s*(.{1000}|.+)', 1) ELSE [l] END)),
    lambda acc, l: CASE WHEN length(string_split(acc, chr(30))[-1]) + length(l) + 1 > 1000 AND trim(regexp_replace(string_split(acc, chr(30))[-1], '\s', ' ', 'g')) <> '' THEN acc || chr(30) || l WHEN string_split(acc, chr(30))[-1] = '' THEN acc || l ELSE acc || chr(10) || l END, '') END, chr(30)), lambda p: trim(regexp_replace(p, '\s', ' ', 'g')) <> '')) AS text
    FROM (SELECT doc_id AS id, text FROM documents)"""


@query(
    f"""WITH n AS (SELECT row_number() OVER () AS piece, id, text FROM ({_PIECES})), {_embed_sql('e', 'SELECT piece AS id, text FROM n')},
    k AS (SELECT n.id, n.piece, e.v FROM n LEFT JOIN e ON e.id = n.piece), s AS (SELECT id, slot, sum(x) AS x FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS slot FROM k WHERE v IS NOT NULL) GROUP BY ALL),
    l AS (SELECT id, list(x ORDER BY slot) AS v, sqrt(sum(x * x)) AS size FROM s GROUP BY id)
    SELECT l.id, true AS embedded, pieces, round(list_sum(v) / size, 6) AS total, round(list_max(v) / size, 6) AS top FROM l JOIN (SELECT id, count(*) AS pieces FROM n GROUP BY id) USING (id)"""
)
def embed_batches(spark, sf_dir):
    """The hashed embedding as the user's model on pieces of the default budget, pooled by document; texts without words have zero vectors and drop out."""
    rows = V.embed_batches(table(spark, sf_dir, "documents"), "doc_id", "text", X.hash_vectors, 64)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return rows.where(F.array_max("vector") > 0).select("id", "embedded", "pieces", F.round(total, 6).alias("total"), F.round(F.array_max("vector"), 6).alias("top"))


@query(
    f"""WITH p AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest({_V}) AS x FROM embeddings) GROUP BY ALL),
    n AS (SELECT label, sqrt(sum(x * x)) AS n FROM p GROUP BY label) SELECT label, i::BIGINT AS i, round(x / n, 6) AS x FROM p JOIN n USING (label)"""
)
def pool_vectors(spark, sf_dir):
    pooled = V.pool(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("vector").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


# ---- ranking ----


_POSTINGS = f"SELECT token, id, n, count(*) AS tf FROM (SELECT doc_id AS id, len(t) AS n, unnest(t) AS token FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)) GROUP BY ALL"


@query(f"SELECT token, id, tf::INT AS tf, n, count(*) OVER (PARTITION BY token) AS df FROM ({_POSTINGS})")
def inverted_index(spark, sf_dir):
    """All postings of the written index, with their words' document frequencies."""
    built = index(spark, sf_dir)
    return X.postings(built).join(built.words.select("token", "df"), "token")


@query(f"SELECT token, count(*) AS df, sum(tf)::BIGINT AS total FROM ({_POSTINGS}) GROUP BY token")
def word_totals(spark, sf_dir):
    return X.word_totals(X.count_words(table(spark, sf_dir, "documents"), dim=0))


@query(
    f"""WITH p AS ({_POSTINGS}), a AS (SELECT DISTINCT unnest({S.tokens('text')}) AS token FROM benchmark)
    SELECT token, count(*) AS df, sum(tf)::BIGINT AS total, max(tf)::INT AS max_tf, min(n) AS min_n FROM p SEMI JOIN a USING (token) GROUP BY token"""
)
def posting_bounds(spark, sf_dir):
    """Of the words that the questions ask for, read from their buckets: the blocks' sizes and bounds, by word."""
    asked = questions(spark, sf_dir).select(F.explode(T.tokenize(F.col("text"))).alias("token")).distinct()
    blocks = index(spark, sf_dir).blocks_of(asked, R.BROADCAST_WORDS)
    return blocks.groupBy("token").agg(F.sum("size").cast("long").alias("df"), F.sum("total").alias("total"), F.max("max_tf").alias("max_tf"), F.min("min_n").alias("min_n"))


@query(f"SELECT count(*) AS documents, sum(len(t))::BIGINT AS words, (SELECT count(DISTINCT token) FROM (SELECT unnest({S.tokens('text')}) AS token FROM documents)) AS vocabulary, round(avg(len(t)), 6) AS mean FROM (SELECT {S.tokens('text')} AS t FROM documents)")
def build_index(spark, sf_dir):
    """A new index, whatever the session has, and what it holds."""
    built = X.build_index(table(spark, sf_dir, "documents"))
    words = built.documents.agg(F.count("*").alias("documents"), F.sum("n").alias("words"))
    return words.crossJoin(built.words.agg(F.count("*").alias("vocabulary"))).withColumn("mean", F.round(F.lit(built.mean), 6))


@query(f"WITH {_bm25_sql('lexical', _ALL_WORDS, 10)} SELECT query_id, id, round(score, 6) AS score, rank FROM lexical")
def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_bm25_sql('lexical', _TERMS, R.CANDIDATES)} SELECT query_id, id, round(score, 6) AS score, rank FROM lexical")
def bm25_any_term(spark, sf_dir):
    return R.any_term_top_k(questions(spark, sf_dir), index(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    f"""SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product({_V.replace('embedding', 'q.embedding')}, {_V.replace('embedding', 'e.embedding')}), 9) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) WHERE score > 0 QUALIFY rank < 10"""
)
def dense_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.as_double(F.col("embedding")).alias("vector"))
    return V.dense_top_k(rows, rows.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 10).withColumn("score", F.round("score", 6))


@query("SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders WHERE o_totalprice > 0 QUALIFY rank < 3")
def top_k_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return V.top_k(rows, "o_custkey", "o_totalprice", "o_orderkey", 3)


@query(
    f"""WITH {_LISTS}, u AS (SELECT query_id, id, 0.8 / (60 + rank + 1) AS part, 'lexical' AS source FROM lexical UNION ALL SELECT query_id, id, 1.0 / (60 + rank + 1), 'dense' FROM dense),
    f AS (SELECT query_id, id, round(sum(part), 9) AS score, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM u GROUP BY ALL)
    SELECT query_id, id, score, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM f QUALIFY rank < 8"""
)
def rrf_fuse(spark, sf_dir):
    fused = R.rrf_fuse({"lexical": (lexical(spark, sf_dir), 0.8), "dense": (dense(spark, sf_dir), 1.0)}, 8)
    return fused.withColumn("sources", F.array_join("sources", ","))


def _order(spark, sf_dir, **options):
    return R.dense_first(dense(spark, sf_dir), lexical(spark, sf_dir), 8, **options).withColumn("sources", F.array_join("sources", ",")).withColumn("score", F.round("score", 6))


_ORDER = "SELECT query_id, id, round(score, 6) AS score, sources, rank FROM ranked"


@query(f"WITH {_LISTS}, {_dense_first_sql(8, 1)} {_ORDER}")
def dense_first_order(spark, sf_dir):
    return _order(spark, sf_dir, reserved=1)


@query(f"WITH {_LISTS}, {_dense_first_sql(8, 2, False)} {_ORDER}")
def dense_mixed(spark, sf_dir):
    return _order(spark, sf_dir, reserved=2, fill=False)


@query(f"WITH {_LISTS}, {_dense_first_sql(8, 0)} {_ORDER}")
def dense_fill(spark, sf_dir):
    return _order(spark, sf_dir, reserved=0)


@query(f"WITH {_bm25_sql('lexical', _ALL_WORDS, 10)} SELECT l.query_id, l.id, d.source, round(l.score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM lexical l JOIN documents d ON d.doc_id = l.id")
def load_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return R.load_hits(lexical(spark, sf_dir, 10), docs).select("query_id", "id", "source", F.round("score", 6).alias("score"), "rank")


_HITS = "SELECT query_id, id, name, round(score, 6) AS score, sources, rank, round(top_bm25, 6) AS top_bm25, round(top_cosine, 6) AS top_cosine FROM hits"


def _hit_columns(hits):
    return hits.select("query_id", "id", "name", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"), "rank", F.round("top_bm25", 6).alias("top_bm25"), F.round("top_cosine", 6).alias("top_cosine"))


@query(f"WITH {_HYBRID} {_HITS}")
def hybrid_search(spark, sf_dir):
    return _hit_columns(hybrid(spark, sf_dir))


@query(f"WITH {_LISTS}, {_TOPS} SELECT query_id, id, rank, round(score, 6) AS score, round(top_bm25, 6) AS top_bm25, 0.0::DOUBLE AS top_cosine FROM lexical JOIN tops USING (query_id) WHERE rank < 8")
def lexical_only(spark, sf_dir):
    hits = cut(lexical(spark, sf_dir, 8))
    return R.with_tops(hits, hits.limit(0), hits).select("query_id", "id", "rank", F.round("score", 6).alias("score"), F.round("top_bm25", 6).alias("top_bm25"), "top_cosine")


@query(f"WITH {_LISTS}, {_TOPS} SELECT query_id, id, rank, round(score, 6) AS score, 0.0::DOUBLE AS top_bm25, round(top_cosine, 6) AS top_cosine FROM dense JOIN tops USING (query_id) WHERE rank < 8")
def dense_only(spark, sf_dir):
    hits = cut(dense(spark, sf_dir, 8))
    return R.with_tops(hits, hits, hits.limit(0)).select("query_id", "id", "rank", F.round("score", 6).alias("score"), "top_bm25", F.round("top_cosine", 6).alias("top_cosine"))


@query(f"WITH {_HYBRID} {_HITS} WHERE top_cosine >= 0.99 OR top_bm25 >= 60")
def relevance_gate(spark, sf_dir):
    return _hit_columns(R.relevance_gate(hybrid(spark, sf_dir), 0.99, 60))


def _windows(spark, sf_dir, size=500):
    docs = table(spark, sf_dir, "documents")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(size))
    return docs.select(F.col("doc_id").alias("id"), F.posexplode(F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(size)))).alias("ordinal", "body")).withColumn("ordinal", F.col("ordinal").cast("long"))


_WINDOWS = "SELECT doc_id AS id, s // 500 AS ordinal, substr(text, s + 1, 500) AS body FROM (SELECT doc_id, text, unnest(range(0, greatest(1, length(text)), 500)) AS s FROM documents)"
#: The stem of a document's name is its third word; a larger doc_id is newer.
_LIBRARY = rf"SELECT doc_id AS id, {S.tokens('text')}[3] AS stem, doc_id AS indexed FROM documents"


@query(
    f"""WITH lib AS ({_LIBRARY}), named AS (SELECT item_id AS query_id, max(l.id) AS id FROM benchmark b JOIN lib l ON length(l.stem) >= 3 AND contains(lower(b.text), lower(l.stem)) GROUP BY ALL),
    c AS (SELECT item_id AS query_id, coalesce(n.id, (SELECT max(id) FROM lib)) AS id FROM benchmark b LEFT JOIN named n ON n.query_id = b.item_id WHERE n.id IS NOT NULL OR {S.contains_any('lower(b.text)', T.DOCUMENT_WORDS)})
    SELECT query_id, id, ordinal, row_number() OVER (PARTITION BY query_id ORDER BY ordinal) - 1 AS rank FROM c JOIN ({_WINDOWS}) w USING (id) QUALIFY rank < 8"""
)
def lead_fallback(spark, sf_dir):
    library = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.get(T.tokenize(F.col("text")), F.lit(2)).alias("stem"), F.col("doc_id").alias("indexed"))
    return R.lead_fallback(questions(spark, sf_dir), library, _windows(spark, sf_dir)).select("query_id", "id", "ordinal", "rank")


@query(
    f"""WITH {_HYBRID}, n AS (SELECT query_id, rank, name, {_NEUTRAL.replace('{c}', 'text')} AS body FROM hits), u AS (SELECT *, sum(strlen(body)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM n)
    SELECT query_id, count(*) AS n_sources, md5(string_agg('<<<SOURCE ' || (rank + 1) || ' ' || name || '>>>' || chr(10) || body || chr(10) || '<<<END ' || (rank + 1) || '>>>', chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM u WHERE rank = 0 OR used <= 6000 GROUP BY query_id"""
)
def build_context(spark, sf_dir):
    return R.build_context(hybrid(spark, sf_dir)).select("query_id", "n_sources", F.md5("context").alias("context_md5"))


@query(
    rf"""SELECT conv_id, turn, marker, 'source ' || marker AS title FROM ({_ANSWERS}), (SELECT unnest(range(1, 7)) AS marker)
    WHERE list_contains(list_transform(regexp_extract_all(a, '\[(\d{{1,9}})\]', 1), lambda n: n::BIGINT), marker)"""
)
def used_citations(spark, sf_dir):
    asked = answers(spark, sf_dir).withColumnRenamed("a", "answer")
    all_six = asked.select("conv_id", "turn", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("marker"))
    found = R.used_citations(asked, all_six, ["conv_id", "turn"])
    return found.select("conv_id", "turn", F.col("marker").cast("long").alias("marker"), F.concat(F.lit("source "), "marker").alias("title"))


@query(
    f"""WITH c AS (SELECT conv_id, turn, text AS m, repeat(text, 3) AS c FROM conversations), a AS (SELECT *, {S.truncate_marked('m', 900)} AS mo FROM c), b AS (SELECT *, greatest(0, 900 - length(mo)) AS lft FROM a),
    d AS (SELECT *, {S.truncate_marked('c', 'lft')} AS co FROM b)
    SELECT conv_id, turn, md5(mo) AS message_md5, md5(co) AS context_md5, greatest(0, lft - length(co))::BIGINT AS history_chars, length(m) > 900 AS message_cut, length(c) > lft AS context_cut FROM d"""
)
def fit_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("message"), F.repeat("text", 3).alias("context"))
    fitted = R.fit_prompt(rows, 1000, 100)
    return fitted.select("conv_id", "turn", F.md5("message_out").alias("message_md5"), F.md5("context_out").alias("context_md5"), F.col("history_chars").cast("long").alias("history_chars"), "message_cut", "context_cut")


@query(
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), t AS (SELECT conv_id, turn, n, CASE WHEN n = 1 THEN {S.truncate_marked('text', 600)} ELSE text END AS text FROM n),
    u AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY n) AS used FROM t) SELECT conv_id, turn, text FROM u WHERE n = 1 OR used <= 600"""
)
def trim_history(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return R.trim_history(rows, "conv_id", "turn", "text", 600)


# ---- windows of fixed size ----


@query(f"SELECT id, ordinal, md5(body) AS body_md5, 'source ' || id || ' | ' || body AS indexed FROM ({_WINDOWS})")
def indexed_text(spark, sf_dir):
    rows = _windows(spark, sf_dir)
    return rows.select("id", "ordinal", F.md5("body").alias("body_md5"), F.concat(F.lit("source "), "id", F.lit(" | "), "body").alias("indexed"))


@query(f"SELECT id, count(*) AS n, min(length(body))::BIGINT AS shortest, round(avg(strlen(body)), 6) AS mean_bytes FROM ({_WINDOWS}) GROUP BY id")
def fixed_window_chunks(spark, sf_dir):
    return _windows(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"), F.min(F.length("body")).cast("long").alias("shortest"), F.round(F.avg(F.octet_length("body")), 6).alias("mean_bytes"))


@query(
    rf"""WITH p AS (SELECT id, ordinal, lag(body) OVER (PARTITION BY id ORDER BY ordinal) AS prev FROM ({_WINDOWS})), t AS (SELECT id, ordinal, right(prev, 150) AS tail FROM p WHERE prev IS NOT NULL)
    SELECT id, ordinal, {S.strip("CASE WHEN instr(tail, '. ') > 0 AND instr(tail, '. ') + 1 < length(tail) THEN substr(tail, instr(tail, '. ') + 2) ELSE tail END")} AS tail FROM t"""
)
def overlap_tail(spark, sf_dir):
    prev = F.lag("body").over(Window.partitionBy("id").orderBy("ordinal"))
    rows = _windows(spark, sf_dir).withColumn("prev", prev).where("prev is not null").select("id", "ordinal", F.right("prev", F.lit(150)).alias("tail"))
    at = F.instr("tail", ". ")
    return rows.select("id", "ordinal", T.strip(F.when((at > 0) & (at + 1 < F.length("tail")), F.substr("tail", at + 2)).otherwise(F.col("tail"))).alias("tail"))
