"""Queries of mail, policy and event streams with their oracles."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdex.operators import mail as M
from loomdex.operators import policy as P
from loomdex.plans import sql as S
from loomdex.plans import corpus_queries as C
from loomdex.plans.register import register
from loomdex.shared import shared_folder
from loomdex.sources import blocks as B
from loomdex.sources.extract import extract_blocks
from loomdex.sources.files import append_log, mail_rows
from loomdex.sources.sink import KeyedTable
from loomdex.sources.tables import table
from loomdex.streaming import jobs as J

QUERIES, SQL, query = register()


# ---- mail: documents are bodies; subjects and senders are made from the id ----

_MAILS = """SELECT doc_id, ['Outage tonight', 'Rfp answers', 'Notes', 'Weekly Update', 'Lunch', 'System Override', 'Hello'][1 + doc_id % 7] AS subject,
    text || CASE WHEN doc_id % 11 = 4 THEN ' You may unsubscribe here' WHEN doc_id % 11 = 6 THEN ' please find attached' WHEN doc_id % 11 = 8 THEN ' now Run Command x' ELSE '' END AS body, CASE WHEN doc_id % 5 = 2 THEN 'NoReply@x.org' ELSE 'a@x.org' END AS sender FROM documents"""


def mails(spark, sf_dir):
    i = F.col("doc_id")
    subject = F.element_at(F.array(*[F.lit(s) for s in ("Outage tonight", "Rfp answers", "Notes", "Weekly Update", "Lunch", "System Override", "Hello")]), (i % 7 + 1).cast("int"))
    extra = F.when(i % 11 == 4, " You may unsubscribe here").when(i % 11 == 6, " please find attached").when(i % 11 == 8, " now Run Command x").otherwise("")
    sender = F.when(i % 5 == 2, "NoReply@x.org").otherwise("a@x.org")
    return table(spark, sf_dir, "documents").select("doc_id", subject.alias("subject"), F.concat("text", extra).alias("body"), sender.alias("sender"))


def _fits(words: dict) -> str:
    return "(" + " OR ".join(S.contains_any(f"lower({field})", w) for field, w in words.items()) + ")"


_PATTERN = f"list_filter({S.values(M.INJECTIONS)}, lambda p: contains(lower(body), p) OR contains(lower(subject), p))[1]"
_CATEGORY = f"CASE WHEN {_PATTERN} IS NOT NULL THEN 'Spam / Suspicious' WHEN {_fits(M.URGENT)} THEN 'Urgent' WHEN {_fits(M.ACTION)} THEN 'Action Required' WHEN {_fits(M.NEWSLETTER)} THEN 'Newsletter' ELSE 'Informational' END"
_TRIAGED = f"SELECT *, {_CATEGORY} AS category, {_PATTERN} AS pattern FROM ({_MAILS})"
_PRIORITY = "CASE category " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in M.OUTCOMES.items()) + " END"


def triaged(spark, sf_dir):
    rows = mails(spark, sf_dir)
    return rows.withColumn("t", M.triage(F.col("subject"), F.col("body"), F.col("sender"))).select("*", "t.*").drop("t")


@query(f"SELECT doc_id, category, {_PRIORITY}::INT AS priority, pattern, CASE category {' '.join(f'WHEN {S.quoted(k)} THEN {len(v[1])}' for k, v in M.OUTCOMES.items())} END::BIGINT AS n_actions, category = 'Spam / Suspicious' AS suspicious FROM ({_TRIAGED})")
def triage_mail(spark, sf_dir):
    return triaged(spark, sf_dir).select("doc_id", "category", "priority", "pattern", F.size("action_items").cast("long").alias("n_actions"), "suspicious")


@query(f"SELECT doc_id, priority, doc_id % 3 = 0 AS has_draft, {S.snippet('body', 90)} AS snippet FROM (SELECT *, {_PRIORITY} AS priority FROM ({_TRIAGED})) WHERE category = 'Urgent'")
def inbox(spark, sf_dir):
    rows = triaged(spark, sf_dir).withColumns({"received": F.col("doc_id"), "draft": F.when(F.col("doc_id") % 3 == 0, "Dear all"), "read": F.col("doc_id") % 2 == 0})
    return M.inbox(rows, "Urgent", urgent_first=True).select("doc_id", "priority", "has_draft", "snippet")


@query(f"SELECT category, count(*) AS mails, count_if(doc_id % 2 = 1)::BIGINT AS unread FROM ({_TRIAGED}) GROUP BY category")
def inbox_counts(spark, sf_dir):
    return triaged(spark, sf_dir).groupBy("category").agg(F.count("*").alias("mails"), F.count_if(F.col("doc_id") % 2 == 1).alias("unread"))


# ---- policy: events are requests ----

_KINDS = {"click": "browser_click", "view": "read_file", "signup": "write_draft", "purchase": "execute_command", "error": "access_credentials"}
_PATHS = ["notes/a.md", "../up.txt", "a/../../b", "/work/ok.txt", "/etc/passwd", "x/.ENV", "deep/nul.txt", "/workspace", "a/../b/./c"]
_REQUESTS = f"SELECT event_id, ts, CASE event_type {' '.join(f'WHEN {S.quoted(k)} THEN {S.quoted(v)}' for k, v in _KINDS.items())} END AS action, user_id % 4 <> 0 AS trusted, {S.values(_PATHS)}[1 + event_id % {len(_PATHS)}] AS path FROM events"
_BAD = ["", "outside", "outside", "", "system", "sensitive", "device", "outside", ""]
_DECIDED = f"""SELECT r.*, CASE WHEN NOT trusted THEN 'Rejected' WHEN action = 'access_credentials' THEN 'Denied' WHEN action IN ('read_file', 'write_draft') AND {S.values(_BAD)}[1 + event_id % {len(_PATHS)}] <> '' THEN 'Denied' WHEN action IN ('browser_click', 'execute_command') THEN 'Confirmed' ELSE 'Allowed' END AS decision,
    CASE WHEN NOT trusted THEN 'untrusted source' WHEN action = 'access_credentials' THEN 'blocked' WHEN action IN ('read_file', 'write_draft') AND {S.values(_BAD)}[1 + event_id % {len(_PATHS)}] <> '' THEN {S.values(_BAD)}[1 + event_id % {len(_PATHS)}] WHEN action IN ('browser_click', 'execute_command') THEN 'held' ELSE 'allowed' END AS reason,
    CASE action WHEN 'browser_click' THEN 'T2' WHEN 'read_file' THEN 'T0' WHEN 'write_draft' THEN 'T1' WHEN 'execute_command' THEN 'T3' ELSE 'Blocked' END AS tier FROM ({_REQUESTS}) r"""


def requests(spark, sf_dir):
    action = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.col("event_type")]
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("event_id") % len(_PATHS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "ts", action.alias("action"), (F.col("user_id") % 4 != 0).alias("trusted"), path.alias("path"))


def decided(spark, sf_dir):
    return P.decide(requests(spark, sf_dir), "/work")


@query(f"SELECT event_id, action, tier, decision, reason FROM ({_DECIDED})")
def decide_requests(spark, sf_dir):
    return decided(spark, sf_dir).select("event_id", "action", "tier", "decision", "reason")


_URL_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
_SYSTEM = " OR ".join(f"lower(p) = '{r}' OR starts_with(lower(p), '{r}/')" for r in P.SYSTEM_ROOTS)


@query(
    f"""SELECT page_id, CASE WHEN {S.contains_any('lower(p)', P.SENSITIVE)} THEN 'sensitive' WHEN {_SYSTEM} THEN 'system' WHEN starts_with(p, '/') AND p <> '/en' AND NOT starts_with(p, '/en/') THEN 'outside' END AS verdict
    FROM (SELECT page_id, {_URL_PATH} || CASE WHEN page_id % 9 = 0 THEN '/.ssh' ELSE '' END AS p FROM pages)"""
)
def path_policy(spark, sf_dir):
    path = F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1), F.when(F.col("page_id") % 9 == 0, "/.ssh").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", P.path_verdict(path, "/en").alias("verdict"))


@query(f"SELECT event_id, action, decision FROM ({_DECIDED}) ORDER BY ts DESC, event_id DESC LIMIT 25")
def audit_recent(spark, sf_dir):
    log = decided(spark, sf_dir).withColumnRenamed("event_id", "id")
    return P.audit_recent(log, 25).select(F.col("id").alias("event_id"), "action", "decision")


@query(f"SELECT tier, decision, trusted, count(*) AS n FROM ({_DECIDED}) GROUP BY ALL")
def audit_counts(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("tier", "decision", "trusted").agg(F.count("*").alias("n"))


@query(
    "SELECT user_id AS target, event_id AS id, CASE WHEN event_type <> 'signup' THEN props END AS before, event_type <> 'signup' AS existed FROM events WHERE event_type IN ('signup', 'purchase', 'click') AND event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
)
def restore_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase', 'click')")
    journal = rows.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("target"), F.when(F.col("event_type") != "signup", F.col("props")).alias("before"), (F.col("event_id") % 3 == 0).alias("undone"))
    return P.restore_state(journal)


# ---- events in time ----


def timed(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def _plain(rows, *columns):
    """Timestamps as text, the same in every engine."""
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


def _text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


@query(
    f"""SELECT t.event_id AS ticket_id, t.user_id AS key, {_text('min(c.ts)')} AS confirmed FROM events t LEFT JOIN events c ON c.user_id = t.user_id AND c.event_type = 'click' AND c.ts > t.ts AND c.ts <= t.ts + INTERVAL 6 HOUR
    WHERE t.event_type = 'purchase' GROUP BY t.event_id, t.user_id"""
)
def ticket_confirmations(spark, sf_dir):
    rows = timed(spark, sf_dir)
    tickets = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("ticket_id"), F.col("user_id").alias("key"), F.col("at").alias("issued"))
    confirms = rows.where("event_type = 'click'").select(F.col("user_id").alias("key"), "at")
    return _plain(J.confirmations(tickets, confirms, 6 * 3600), "confirmed").select("ticket_id", "key", "confirmed")


_RUNS = "WITH g AS (SELECT user_id AS key, event_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)"


@query(f"{_RUNS} SELECT key, {_text('min(ts)')} AS start, {_text('max(ts)')} AS stop, count(*) AS n FROM r GROUP BY key, run HAVING max(ts) - min(ts) >= INTERVAL 30 MINUTE")
def activity_segments(spark, sf_dir):
    events = timed(spark, sf_dir).select(F.col("user_id").alias("key"), "at")
    return _plain(J.segments(events, "6 hours", 1800), "start", "stop")


#: Event after event: one opens a segment if the last is 6 hours back, or its segment's start 8 hours.
_SPLIT = f"""WITH RECURSIVE e AS (SELECT user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT key, i, ts, ts AS start FROM e WHERE i = 1
      UNION ALL SELECT e.key, e.i, e.ts, CASE WHEN e.ts - s.ts >= INTERVAL 6 HOUR OR e.ts - s.start >= INTERVAL 8 HOUR THEN e.ts ELSE s.start END FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1)
    SELECT key, {_text('start')} AS start, {_text('max(ts)')} AS stop, count(*) AS n FROM s GROUP BY key, start HAVING max(ts) - start >= INTERVAL 30 MINUTE"""


@query(_SPLIT)
def activity_segments_split(spark, sf_dir):
    events = timed(spark, sf_dir).select(F.col("user_id").alias("key"), "at")
    return _plain(J.split_segments(events, 6 * 3600, 8 * 3600, 1800), "start", "stop")


def arriving(spark, sf_dir, name):
    """The events as a stream of files, and behind them one of another user that moves the watermark beyond all others."""
    folder = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    rows = timed(spark, sf_dir).select("event_id", "user_id", "event_type", "at")
    last = rows.agg((F.coalesce(F.max("at"), F.timestamp_seconds(F.lit(0))) + F.expr("INTERVAL 30 DAYS")).alias("at"))
    last = last.select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), "at")
    rows.unionByName(last).write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder


@query(SQL["ticket_confirmations"])
def stream_tickets(spark, sf_dir):
    """Tickets and confirmations as one stream, held by user until each ticket is confirmed or has expired."""
    events, folder = arriving(spark, sf_dir, "tickets")
    both = events.where("event_type in ('purchase', 'click', 'end')").select(F.col("user_id").alias("key"), "at", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("ticket_id"))
    return _plain(J.drained(J.stream_confirmations(both, 6 * 3600), folder, "append"), "confirmed").select("ticket_id", "key", "confirmed")


@query(_SPLIT)
def stream_segments(spark, sf_dir):
    """The segments of activity_segments_split, of the events as a stream."""
    events, folder = arriving(spark, sf_dir, "segments")
    found = J.drained(J.stream_segments(events.select(F.col("user_id").alias("key"), "at"), 6 * 3600, 8 * 3600, 1800), folder, "append")
    return _plain(found, "start", "stop")


@query(f"SELECT {_text('time_bucket(INTERVAL 1 DAY, ts)')} AS start, tier, count(*) AS n FROM ({_DECIDED}) GROUP BY ALL")
def audit_rates(spark, sf_dir):
    rows = decided(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("at"), "tier")
    return _plain(J.rates(rows, "1 day"), "start").select("start", "tier", "n")


@query(f"SELECT {_text('s')} AS start, tier, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s, tier FROM ({_DECIDED})) GROUP BY ALL")
def audit_rates_sliding(spark, sf_dir):
    rows = decided(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("at"), "tier")
    return _plain(J.rates(rows, "12 hours", "6 hours"), "start").select("start", "tier", "n")


@query(f"SELECT {_text('time_bucket(INTERVAL 1 DAY, ts)')} AS start, event_type AS tier, count(*) AS n FROM events GROUP BY ALL")
def stream_rates(spark, sf_dir):
    """The events as a stream, counted by day and type until all have arrived."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = J.rates(stream.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("tier")), "1 day", late="1 hour")
    return _plain(J.drained(rows, f"{shared_folder(spark)}/stream-rates-{uuid4().hex}", "complete"), "start").select("start", "tier", "n")


@query(f"SELECT tier, decision, count(*) AS n FROM ({_DECIDED}) GROUP BY ALL")
def audit_append(spark, sf_dir):
    """Decisions added to an append-only log in two writes, then counted in it."""
    log, rows = f"{shared_folder(spark)}/audit-{uuid4().hex}", decided(spark, sf_dir)
    for part in (rows.where("trusted"), rows.where("not trusted")):
        append_log(part.select("event_id", "tier", "decision"), log)
    return spark.read.parquet(log).groupBy("tier", "decision").agg(F.count("*").alias("n"))


def _blocks_sink(spark, folder):
    return KeyedTable(spark, f"{folder}/table", StructType.fromDDL("id long, version long, pos long, kind string, text string"), "id", "version")


@query(C.SQL["blocks_text"])
def stream_ingest(spark, sf_dir):
    """The documents arrive as files, are cut into blocks and stored once each: what the batch query gives."""
    folder = f"{shared_folder(spark)}/ingest-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("version"), "text")
    # a file for each part of the input, which arrive in two batches
    files = max(4, docs.rdd.getNumPartitions())
    docs.repartition(files).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(f"{folder}/in")
    extract = lambda rows: B.text_blocks(rows, "id", "text", "\n").join(rows.select("id", "version"), "id")
    sink = _blocks_sink(spark, folder)
    J.ingest(arriving, extract, sink, f"{folder}/quarantine", f"{folder}/state").awaitTermination()
    return sink.read().select("id", "pos", "kind", "text")


@query(
    f"""WITH f AS ({C.MIXED}), b AS (SELECT id, count(*) AS n FROM ({C.EXTRACTED}) WHERE error IS NULL GROUP BY id), e AS (SELECT id, error FROM ({C.EXTRACTED}) WHERE error IS NOT NULL)
    SELECT f.id, CASE WHEN f.id % 10 = 3 AND error IS NULL THEN 2 ELSE 1 END::BIGINT AS version, coalesce(n, 0) AS blocks, error FROM f LEFT JOIN b USING (id) LEFT JOIN e USING (id)"""
)
def stream_quarantine(spark, sf_dir):
    """Files of several formats arrive, some of them again in a newer and an older version: blocks stored by document, and why the others failed."""
    folder = f"{shared_folder(spark)}/quarantine-{uuid4().hex}"
    files = C.mixed_files(spark, sf_dir).withColumn("version", F.lit(1).cast("long"))
    again = files.where("id % 10 = 3")
    stale = again.withColumns({"version": F.lit(0).cast("long"), "content": F.encode(F.lit("stale"), "UTF-8")})
    for part in (files, again.withColumn("version", F.lit(2).cast("long")).union(stale.select(*files.columns)), stale.select(*files.columns)):
        part.write.mode("append").parquet(f"{folder}/in")
    arriving = spark.readStream.schema(files.schema).parquet(f"{folder}/in")
    sink = _blocks_sink(spark, folder)
    J.ingest(arriving, extract_blocks, sink, f"{folder}/quarantine", f"{folder}/state").awaitTermination()
    stored = sink.read().groupBy("id", "version").agg(F.count("*").alias("blocks"), F.lit(None).cast("string").alias("error"))
    failed = spark.read.parquet(f"{folder}/quarantine").select("id", F.lit(1).cast("long").alias("version"), F.lit(0).cast("long").alias("blocks"), "error")
    return stored.unionByName(failed)


def _sent_header():
    """A Date header for each document: minutes of some seventy days, in an order of their own."""
    sent = F.timestamp_seconds(F.lit(1_704_067_200) + 60 * (F.col("doc_id") * 7919 % 100_000))
    return F.concat(F.lit("Mon, "), F.date_format(sent, "d MMM yyyy HH:mm:ss Z"))


@query(f"SELECT doc_id, category, pattern FROM ({_TRIAGED})")
def stream_mail(spark, sf_dir):
    """The mails arrive as files, each twice, are parsed, and triaged once each."""
    folder = f"{shared_folder(spark)}/mail-{uuid4().hex}"
    head = F.concat(F.lit("Message-ID: "), "doc_id", F.lit("\nDate: "), _sent_header(), F.lit("\nFrom: "), "sender", F.lit("\nSubject: "), "subject", F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "body")
    files = mails(spark, sf_dir).select(F.concat(F.lit("mail/"), "doc_id").alias("path"), F.encode(head, "UTF-8").alias("content"))
    for _ in range(2):
        files.write.mode("append").parquet(f"{folder}/in")
    arriving = spark.readStream.schema(files.schema).parquet(f"{folder}/in")
    triage = lambda rows: rows.select(F.col("message_id").cast("long").alias("doc_id"), M.triage(F.col("subject"), F.col("body"), F.col("sender")).alias("t")).select("doc_id", "t.category", "t.pattern")
    return J.drained(J.mail_stream(arriving, mail_rows, triage), f"{folder}/out", "append")


@query(
    f"""SELECT key, message_id, {_text('sent')} AS sent FROM (SELECT 'box' || doc_id % 13 AS key, doc_id::VARCHAR AS message_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7919 % 100000) AS sent FROM documents)
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY sent DESC, message_id DESC) <= 5"""
)
def stream_mailbox(spark, sf_dir):
    """The mails arrive as files, each twice; every mailbox keeps its five newest."""
    folder = f"{shared_folder(spark)}/mailbox-{uuid4().hex}"
    head = F.concat(F.lit("Message-ID: "), "doc_id", F.lit("\nDate: "), _sent_header(), F.lit("\nTo: box"), F.col("doc_id") % 13, F.lit("\nSubject: Hello\n\nbody"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("mail/"), "doc_id").alias("path"), F.encode(head, "UTF-8").alias("content"))
    for _ in range(2):
        files.write.mode("append").parquet(f"{folder}/in")
    arriving = spark.readStream.schema(files.schema).parquet(f"{folder}/in")
    mails = J.mail_stream(arriving, mail_rows, lambda rows: rows.select("message_id", "recipient", "sent"))
    found = J.standing(J.drained(J.latest_mails(mails, "recipient", 5), f"{folder}/out", "append"))
    return _plain(found, "sent").select("key", "message_id", "sent")
