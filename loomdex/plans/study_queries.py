"""Queries of evaluation and table reports with their oracles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from loomdex.operators import evaluation as E
from loomdex.operators import index as X
from loomdex.operators import retrieval as R
from loomdex.operators import tables as A
from loomdex.plans import corpus_queries as C
from loomdex.plans import retrieval_queries as Q
from loomdex.plans import sql as S
from loomdex.plans.register import register
from loomdex.sources import blocks as B
from loomdex.shared import cut, written
from loomdex.sources.tables import table

QUERIES, SQL, query = register()
KS = [4, 8]
#: The index of texts that are asked for by their words alone, by many queries at once.
build_index = partial(X.build_index, dim=0, inverted=False)


# ---- evaluation: an item's text is its anchor ----

_RELEVANT = "relevant AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def relevant(spark, sf_dir):
    anchors = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("anchor"))
    return E.resolve_anchors(anchors, table(spark, sf_dir, "documents"), Q.index(spark, sf_dir))


@query(f"WITH {_RELEVANT} SELECT query_id, id FROM relevant")
def resolve_anchors(spark, sf_dir):
    return relevant(spark, sf_dir)


def _outcome_sql(name: str, runs: str, ks) -> str:
    """(strategy, k, query_id, recall, rr, precision) of runs (strategy, query_id, id, rank)."""
    return f"""{name} AS (WITH runs AS ({runs}), h AS (SELECT r.*, q.id IS NOT NULL AS hit, k FROM runs r LEFT JOIN relevant q ON q.query_id = r.query_id AND q.id = r.id, (SELECT unnest({list(ks)}) AS k) WHERE rank < k),
    g AS (SELECT strategy, k, query_id, min(CASE WHEN hit THEN rank END) AS place, count_if(hit) AS hits, count(*) AS returned FROM h GROUP BY ALL),
    asked AS (SELECT strategy, k, query_id FROM (SELECT DISTINCT query_id FROM relevant), (SELECT DISTINCT strategy FROM runs), (SELECT unnest({list(ks)}) AS k))
    SELECT strategy, k, query_id, CASE WHEN place IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS recall, coalesce(1.0::DOUBLE / (place + 1), 0) AS rr, coalesce(hits::DOUBLE / least(returned, k), 0) AS precision FROM asked LEFT JOIN g USING (strategy, k, query_id))"""


_RUNS = "SELECT 'bm25' AS strategy, query_id, id, rank FROM lexical UNION ALL SELECT 'dense', query_id, id, rank FROM dense UNION ALL SELECT 'dense_first', query_id, id, rank FROM ranked"
_OUTCOMES = f"{Q._LISTS}, {Q._dense_first_sql(8, 1)}, {_RELEVANT}, {_outcome_sql('outcomes', _RUNS, KS)}"


def outcomes(spark, sf_dir):
    lists = {"bm25": cut(Q.lexical(spark, sf_dir)), "dense": cut(Q.dense(spark, sf_dir))}
    lists["dense_first"] = R.dense_first(lists["dense"], lists["bm25"], 8, 1)
    runs = None
    for name, rows in lists.items():
        own = rows.select(F.lit(name).alias("strategy"), "query_id", "id", "rank")
        runs = own if runs is None else runs.union(own)
    return E.score_questions(runs, relevant(spark, sf_dir), KS, ("strategy",))


_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in E.METRICS)


def _rounded(rows, *keys):
    return rows.select(*keys, *[F.round(m, 6).alias(m) for m in E.METRICS])


@query(f"WITH {Q._bm25_sql('lexical', Q._ALL_WORDS, 10)}, {_RELEVANT}, {_outcome_sql('o', chr(39).join(['SELECT ', 'bm25', ' AS strategy, query_id, id, rank FROM lexical']), [10])} SELECT query_id, {_ROUNDED} FROM o")
def score_questions(spark, sf_dir):
    return _rounded(E.score_questions(Q.lexical(spark, sf_dir, 10), relevant(spark, sf_dir), [10]), "query_id")


@query(
    f"""WITH {Q._bm25_sql('lexical', Q._ALL_WORDS, 10)}, {_RELEVANT}, {_outcome_sql('o', chr(39).join(['SELECT ', 'bm25', ' AS strategy, query_id, id, rank FROM lexical']), [10])}, p AS (SELECT *, 'probe ' || query_id % 3 AS probe FROM o)
    SELECT coalesce(probe, 'all') AS probe, count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(precision), 6) AS precision, count_if(recall = 0)::BIGINT AS failures FROM p GROUP BY ROLLUP (probe)"""
)
def eval_report(spark, sf_dir):
    scored = E.score_questions(Q.lexical(spark, sf_dir, 10), relevant(spark, sf_dir), [10])
    probes = Q.questions(spark, sf_dir).select("query_id", F.concat(F.lit("probe "), F.col("query_id") % 3).alias("probe"))
    return _rounded(E.report(scored, probes), "probe", "questions", "failures")


@query(f"WITH {_OUTCOMES} SELECT strategy, k::BIGINT AS k, count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(precision), 6) AS precision FROM outcomes GROUP BY ALL")
def strategy_matrix(spark, sf_dir):
    rows = outcomes(spark, sf_dir).groupBy("strategy", F.col("k").cast("long").alias("k")).agg(F.count("*").alias("questions"), *[F.avg(m).alias(m) for m in E.METRICS])
    return _rounded(rows, "strategy", "k", "questions")


_PAIRED = f"""{_OUTCOMES}, l AS (SELECT strategy, query_id, unnest(['recall', 'rr', 'precision']) AS metric, unnest([recall, rr, precision]) AS v FROM outcomes WHERE k = 8),
    d AS (SELECT metric, a.query_id, a.v AS a, b.v AS b, a.v - b.v AS d FROM l a JOIN l b USING (metric, query_id) WHERE a.strategy = 'dense_first' AND b.strategy = 'bm25')"""


def _pair(spark, sf_dir):
    rows = outcomes(spark, sf_dir).where("k = 8")
    return rows.where("strategy = 'dense_first'"), rows.where("strategy = 'bm25'")


@query(
    f"""WITH {_PAIRED} SELECT metric, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(d), 6) AS delta, count_if(d > 1e-6)::BIGINT AS wins, count_if(d < -1e-6)::BIGINT AS losses, count_if(abs(d) <= 1e-6)::BIGINT AS ties FROM d GROUP BY metric"""
)
def compare_paired(spark, sf_dir):
    rows = E.compare_paired(*_pair(spark, sf_dir))
    return rows.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "delta")], "wins", "losses", "ties")


@query(
    """WITH c AS (SELECT c_nationkey, count_if(c_acctbal > 6000)::BIGINT AS wins, count_if(c_acctbal < 1000)::BIGINT AS losses FROM customer GROUP BY ALL)
    SELECT c_nationkey, wins, losses, CASE WHEN wins + losses = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))), 6) END::DOUBLE AS p FROM c"""
)
def sign_test(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 6000).alias("wins"), F.count_if(F.col("c_acctbal") < 1000).alias("losses"))
    return counts.select("c_nationkey", "wins", "losses", F.round(E.sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


@query(
    """WITH c AS (SELECT l_returnflag, l_linestatus, l_shipmode, count_if(l_quantity > 25)::BIGINT AS wins, count_if(l_quantity < 25.5 + (l_linestatus = 'O')::INT)::BIGINT AS losses FROM (SELECT *, l_linenumber AS l_shipmode FROM lineitem) GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, l_shipmode AS l_linenumber, wins, losses, round(least(1.0, list_sum(list_transform(range(least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses - 1) * ln(2))))), 6)::DOUBLE AS p FROM c"""
)
def sign_test_large(spark, sf_dir):
    """The sign test of counts in the thousands."""
    wins, losses = F.count_if(F.col("l_quantity") > 25), F.count_if(F.col("l_quantity") < 25.5 + (F.col("l_linestatus") == "O").cast("int"))
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(wins.alias("wins"), losses.alias("losses"))
    return counts.select("l_returnflag", "l_linestatus", "l_linenumber", "wins", "losses", F.round(E.sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


@query(
    f"""WITH {_PAIRED}, v AS (SELECT d, row_number() OVER (ORDER BY query_id) - 1 AS i FROM d WHERE metric = 'rr'), n AS (SELECT count(*) AS n FROM v),
    r AS (SELECT rep, ('0x' || substr(md5(rep || ':' || draw), 1, 8))::BIGINT % n AS i FROM (SELECT unnest(range(10000)) AS rep), n, LATERAL (SELECT unnest(range(n)) AS draw)),
    means AS (SELECT rep, round(avg(d), 9) AS mean FROM r JOIN v USING (i) GROUP BY rep), o AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS place FROM means)
    SELECT round(max(CASE WHEN place = 250 THEN mean END), 6) AS low, round(max(CASE WHEN place = 9750 THEN mean END), 6) AS high FROM o"""
)
def bootstrap_ci(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    deltas = a.select("query_id", F.col("rr").alias("x")).join(b.select("query_id", F.col("rr").alias("y")), "query_id").select("query_id", (F.col("x") - F.col("y")).alias("delta"))
    return E.bootstrap_ci(deltas).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    """WITH c AS (SELECT lang, sum(quality)::BIGINT AS good, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang), p AS (SELECT *, good::DOUBLE / n AS p, 1.96 * 1.96 AS z2 FROM c)
    SELECT lang, good, n, round(greatest(0, least(1, (p + z2 / (2 * n)) / (1 + z2 / n) - 1.96 / (1 + z2 / n) * sqrt(p * (1 - p) / n + z2 / (4 * n * n)))), 6)::DOUBLE AS low, round(greatest(0, least(1, (p + z2 / (2 * n)) / (1 + z2 / n) + 1.96 / (1 + z2 / n) * sqrt(p * (1 - p) / n + z2 / (4 * n * n)))), 6)::DOUBLE AS high FROM p"""
)
def wilson_interval(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    low, high = E.wilson(F.col("good"), F.col("n"))
    return rows.select("lang", "good", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_PAGES = f"""pb AS ({C.html_sql()}), ph AS (SELECT id, arg_min(text, pos) AS heading FROM pb WHERE kind = 'heading' GROUP BY id), pt AS (SELECT id, string_agg(text, chr(10) ORDER BY pos) AS body FROM pb WHERE kind <> 'heading' GROUP BY id),
    pg AS (SELECT id, heading, body FROM ph JOIN pt USING (id))"""
_ASKED = f"SELECT id AS query_id, unnest({S.tokens('heading')}) AS token FROM pg"


@query(
    f"""WITH {_PAGES}, {Q._bm25_sql('trail', _ASKED, 8, "SELECT id, heading || chr(10) || body AS text FROM pg")}, {Q._bm25_sql('plain', _ASKED, 8, "SELECT id, body AS text FROM pg")}, relevant AS (SELECT id AS query_id, id FROM pg),
    {_outcome_sql('o', "SELECT 'with trail' AS strategy, query_id, id, rank FROM trail UNION ALL SELECT 'without trail', query_id, id, rank FROM plain", [8])} SELECT strategy, {', '.join(f'round(avg({m}), 6) AS {m}' for m in E.METRICS)} FROM o GROUP BY strategy"""
)
def ablation(spark, sf_dir):
    """Pages as documents with and without their heading, asked for by the heading's words; pages of one heading ask once, and each is scored by the answer."""
    blocks = B.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html")
    parts = F.collect_list(F.when(F.col("kind") != "heading", F.struct("pos", "text"))).alias("parts")
    both = blocks.groupBy(F.col("id").alias("doc_id")).agg(F.expr("min_by(text, pos) FILTER (WHERE kind = 'heading')").alias("heading"), parts).where("heading is not null and size(parts) > 0")
    pages = cut(both.select("doc_id", "heading", F.array_join(F.transform(F.array_sort("parts"), lambda s: s["text"]), "\n").alias("body")))
    asked = cut(pages.groupBy(F.col("heading").alias("text")).agg(F.min("doc_id").alias("query_id"), F.collect_list("doc_id").alias("asking")))
    truth = pages.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("id"))
    runs = None
    for name, text in (("with trail", F.concat_ws("\n", "heading", "body")), ("without trail", F.col("body"))):
        ranked = R.bm25_top_k(asked.select("query_id", "text"), build_index(pages.select("doc_id", text.alias("text"))), 8)
        # read several times below
        own = cut(ranked.join(asked, "query_id").select(F.lit(name).alias("strategy"), F.explode("asking").alias("query_id"), "id", "rank"))
        runs = own if runs is None else runs.union(own)
    rows = E.score_questions(runs, truth, [8], ("strategy",)).groupBy("strategy").agg(*[F.avg(m).alias(m) for m in E.METRICS])
    return _rounded(rows, "strategy")


# ---- tables ----


@query(f"SELECT source, count(DISTINCT id) AS documents, count(*) AS chunks, max(id) AS newest FROM ({Q._WINDOWS}) JOIN documents ON doc_id = id GROUP BY source")
def library_stats(spark, sf_dir):
    chunks = Q._windows(spark, sf_dir).groupBy("id").agg(F.count("*").alias("chunks"))
    rows = chunks.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.max("id").alias("newest")).orderBy(F.desc("newest"), "source")


@query(
    f"""WITH s AS (SELECT DISTINCT conv_id FROM conversations UNION ALL SELECT -7), m AS (SELECT conv_id, count(*) AS n, arg_max(text, turn) AS t FROM conversations GROUP BY conv_id)
    SELECT conv_id, coalesce(n, 0) AS messages, {S.snippet('t', 80)} AS last FROM s LEFT JOIN m USING (conv_id)"""
)
def session_summaries(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    sessions = rows.select("conv_id").distinct().union(spark.range(1).select(F.lit(-7).cast("long").alias("conv_id")))
    return A.session_summaries(sessions, rows, "conv_id", "turn", "text")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def recent_messages(spark, sf_dir):
    return A.recent(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3).orderBy("conv_id", "turn")


@query("SELECT coalesce(l_returnflag, 'Total') AS l_returnflag, round(sum(l_quantity), 2) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def table_with_totals(spark, sf_dir):
    rows = A.with_totals(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity"], ["l_extendedprice"])
    return rows.select("l_returnflag", F.round("l_quantity", 2).alias("l_quantity"), F.round("l_extendedprice", 6).alias("l_extendedprice"))


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, max(CASE WHEN i = round((n - 1) * 0.5) THEN value END) AS p50, max(CASE WHEN i = round((n - 1) * 0.95) THEN value END) AS p95 FROM r GROUP BY event_type"""
)
def latency_summary(spark, sf_dir):
    rows = A.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return rows.select("event_type", "n", F.round("mean", 6).alias("mean"), "p50", "p95")


@query("SELECT event_type, count(*) AS n, count(DISTINCT ts::DATE) AS sketches, true AS p50_within, true AS p95_within FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_sketches(spark, sf_dir):
    """Percentiles from sketches kept by type and day and merged by type: whether they lie within a hundredth of their rank."""
    events, shares = table(spark, sf_dir, "events"), {"p50": 0.5, "p95": 0.95}
    daily = written(A.value_sketches(events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value"), "sketches")
    found = cut(A.sketched_percentiles(daily, "event_type", shares))
    errors = A.rank_errors(events, "event_type", "value", found, shares)
    within = errors.select("event_type", *[(F.col(name) <= 0.01).alias(f"{name}_within") for name in shares])
    return found.select("event_type", "n", "sketches").join(within, "event_type")


@query(
    """WITH b(event_type, budget) AS (VALUES ('click', 1000.0), ('view', 1e12), ('error', 500.0)), s AS (SELECT event_type, sum(value) AS spent, max(budget)::DOUBLE AS budget FROM events LEFT JOIN b USING (event_type) GROUP BY event_type),
    a AS (FROM s UNION ALL SELECT 'total', sum(spent), 1e6::DOUBLE FROM s) SELECT event_type, round(spent, 4) AS spent, budget, CASE WHEN budget IS NULL THEN 'NO BUDGET' WHEN spent > budget THEN 'FAIL' ELSE 'PASS' END AS verdict FROM a"""
)
def budget_report(spark, sf_dir):
    spent = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("spent"))
    budgets = spark.createDataFrame([("click", 1000.0), ("view", 1e12), ("error", 500.0)], "event_type string, budget double")
    return A.budget_report(spent, budgets, "event_type", 1e6).withColumn("spent", F.round("spent", 4))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def distinct_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return A.distinct_first(rows, ["text_md5"], "doc_id")


@query(
    f"""WITH {Q._LISTS}, u AS (SELECT query_id, id, 'lexical' AS source FROM lexical WHERE rank < 8 UNION ALL SELECT query_id, id, 'dense' FROM dense WHERE rank < 8)
    SELECT query_id, id, string_agg(source, ',' ORDER BY source) AS sources FROM u GROUP BY ALL"""
)
def union_ranked(spark, sf_dir):
    named = lambda rows, name: rows.where("rank < 8").select("query_id", "id", F.lit(name).alias("source"))
    both = named(Q.lexical(spark, sf_dir), "lexical").unionByName(named(Q.dense(spark, sf_dir), "dense"))
    return both.groupBy("query_id", "id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def missing_items(spark, sf_dir):
    present = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").exceptAll(present.distinct())
