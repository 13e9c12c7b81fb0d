"""Streams give what the same job gives on the whole table."""

import datetime
import math

import pytest
from loomdex.operators import mail as M
from loomdex.plans import event_queries as Q
from loomdex.sources import blocks as B
from loomdex.sources import files as X
from loomdex.sources.extract import extract_blocks
from loomdex.sources.sink import KeyedTable
from loomdex.streaming import jobs as J
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@pytest.fixture(scope="module")
def parts(spark, tiny, tmp_path_factory):
    """The events in time order as files that a stream reads one by one, and a last event that moves the watermark on."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = Q.timed(spark, tiny).select("event_id", "at", "user_id", "event_type")
    last = spark.createDataFrame([(-1, -1, "click")], "event_id long, user_id long, event_type string").select("event_id", (F.lit("2031-01-01").cast("timestamp")).alias("at"), "user_id", "event_type")
    for i, (a, b) in enumerate((("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2030-01-01"))):
        events.where(f"at >= '{a}' and at < '{b}'").coalesce(1).write.mode("append").parquet(folder)
    last.coalesce(1).write.mode("append").parquet(folder)
    return events, folder


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def run(spark, frame, tmp_path, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return sorted(map(tuple, spark.table(name).collect()))


def test_segments(spark, parts, tmp_path):
    events, folder = parts
    keyed = lambda rows: rows.select(F.col("user_id").alias("key"), "at")
    batch = sorted(map(tuple, J.segments(keyed(events), "6 hours", 1800).collect()))
    got = run(spark, J.segments(keyed(stream(spark, folder)).withWatermark("at", "0 seconds"), "6 hours", 1800), tmp_path, "segments_out")
    assert got == batch


def segments_one_by_one(events, gap, longest, least):
    """(key, start, stop, n) by walking the events of each key, times in seconds."""
    out = []
    for key in {k for k, _ in events}:
        times, held = sorted(t for k, t in events if k == key), None
        for t in [*times, math.inf]:
            if held and (t - held[1] >= gap or t - held[0] >= longest):
                out.append((key, *held))
                held = None
            held = (held[0], t, held[2] + 1) if held else (t, t, 1)
    return sorted(o for o in out if o[2] - o[1] >= least)


def keyed_seconds(rows):
    return sorted((r.key, r.start.timestamp(), r.stop.timestamp(), r.n) for r in rows.collect())


@pytest.mark.parametrize("longest", [3 * 3600, 8 * 3600, 10**9])
def test_split_segments_in_batch(spark, parts, longest):
    events = parts[0].select(F.col("user_id").alias("key"), "at")
    expected = segments_one_by_one([(r.key, r["at"].timestamp()) for r in events.collect()], 6 * 3600, longest, 1800)
    assert keyed_seconds(J.split_segments(events, 6 * 3600, longest, 1800)) == expected


def test_a_segment_restarts_at_the_event_that_breaks_it(spark):
    """At a limit of 30, the times 0, 29, 45, 62 are two segments: 45 opens one that lasts until 75."""
    frame = spark.createDataFrame([(1, float(t)) for t in (0, 29, 45, 62)], "key long, s double").select("key", F.timestamp_seconds("s").alias("at"))
    assert keyed_seconds(J.split_segments(frame, 100, 30, 0)) == [(1, 0, 29, 2), (1, 45, 62, 2)]
    assert J.split_segments(frame.limit(0), 100, 30, 0).collect() == []


def test_split_segments_on_a_stream(spark, parts, tmp_path):
    events, folder = parts
    own = lambda rows: rows.select(F.col("user_id").alias("key"), "at")
    batch = keyed_seconds(J.split_segments(own(events), 6 * 3600, 8 * 3600, 1800))
    got = J.drained(J.stream_segments(own(stream(spark, folder)), 6 * 3600, 8 * 3600, 1800), str(tmp_path / "split"), "append")
    assert keyed_seconds(got) == batch and len(batch) != J.split_segments(own(events), 6 * 3600, 10**9, 1800).count()


def test_rates(spark, parts, tmp_path):
    events, folder = parts
    tiers = lambda rows: rows.select("at", F.col("event_type").alias("tier"))
    batch = sorted(map(tuple, J.rates(tiers(events), "1 day").collect()))
    got = run(spark, J.rates(tiers(stream(spark, folder)), "1 day", late="1 hour"), tmp_path, "rates_out")
    assert got == batch


def test_confirmations(spark, parts, tmp_path):
    events, folder = parts
    tickets = events.where("event_type = 'purchase'").select(F.col("event_id").alias("ticket_id"), F.col("user_id").alias("key"), F.col("at").alias("issued"))
    confirms = events.where("event_type = 'click'").select(F.col("user_id").alias("key"), "at")
    batch = sorted(map(tuple, J.confirmations(tickets, confirms, 6 * 3600).collect()), key=repr)
    both = stream(spark, folder).where("event_type in ('purchase', 'click')").select(F.col("user_id").alias("key"), "at", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("ticket_id"))
    got = sorted(map(tuple, J.drained(J.stream_confirmations(both, 6 * 3600), str(tmp_path / "tickets"), "append").collect()), key=repr)
    assert got == batch and len({r[0] for r in got}) == len(got) and any(r[3] for r in got) and not all(r[3] for r in got)


def test_confirmations_in_any_order_within_the_delay(spark, tmp_path):
    """Confirmations that arrive before their ticket, or after a later one, still count as the first."""
    second = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)
    batches = [[(1, 50, None), (1, 100, None)], [(1, 10, 7), (1, 40, None), (2, 0, 8)], [(1, 90, 9)], [(1, 10_000, None), (2, 10_000, None), (1, 9_990, 10)], [(3, 10**6, None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, second(t), n) for k, t, n in rows], "key long, at timestamp, ticket_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("key long, at timestamp, ticket_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = J.drained(J.stream_confirmations(arriving, 120, "200 seconds"), str(tmp_path / "out"), "append").collect()
    since = lambda t: t and t.timestamp() - second(0).timestamp()
    assert sorted((r.ticket_id, r.key, since(r.issued), since(r.confirmed)) for r in got) == [(7, 1, 10, 40), (8, 2, 0, None), (9, 1, 90, 100), (10, 1, 9990, 10000)]


def blocks_sink(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "table"), StructType.fromDDL("id long, version long, pos long, kind string, text string"), "id", "version", buckets=8)


def test_ingest_keeps_the_newest_version_and_quarantines_failures(spark, tmp_path):
    shape, source = "id long, version long, format string, content binary", str(tmp_path / "in")
    feeds = [
        [(1, 1, "Text", b"one\n\ntwo"), (2, 1, "Text", b"\xff"), (3, 1, "PDF", b"x"), (4, 1, "CSV", b"a,b\n1,2\n"), (4, 3, "CSV", b"a,b\n5,6\n7,\n"), (4, 2, "CSV", b"a\n9\n")],
        [(1, 2, "Text", b"  "), (2, 2, "Text", b"now right"), (4, 2, "Text", b"late and old"), (5, 1, "Mail", b"Subject: Hi\n\nbody")],
    ]
    sink = blocks_sink(spark, tmp_path)
    for rows in feeds:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):
        J.ingest(arriving, extract_blocks, sink, str(tmp_path / "quarantine"), str(tmp_path / "state")).awaitTermination(240)
    assert sorted((r.id, r.version, r.pos, r.text) for r in sink.read().collect()) == [(1, 1, 0, "one"), (1, 1, 1, "two"), (2, 2, 0, "now right"), (4, 3, 0, "a: 5 · b: 6"), (4, 3, 1, "a: 7"), (5, 1, 0, "Hi"), (5, 1, 1, "body")]
    bad = sorted((r.id, r.version, r.error.partition(":")[0], r.batch) for r in spark.read.parquet(str(tmp_path / "quarantine")).collect())
    assert bad == [(1, 2, "ValueError", 1), (2, 1, "UnicodeDecodeError", 0), (3, 1, "LookupError", 0)]


def test_ingest_counts_each_document_once(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("version"), "text").limit(40).cache()
    source = str(tmp_path / "in")
    docs.where("id % 2 = 0").write.mode("append").parquet(source)
    docs.where("id % 2 = 1").union(docs.where("id = 0").select("id", F.lit(2).cast("long"), F.lit("Another text of the first."))).write.mode("append").parquet(source)
    prepare = lambda rows: B.text_blocks(rows, "id", "text", "\n").join(rows.select("id", "version"), "id")
    arriving, sink = spark.readStream.schema(docs.schema).parquet(source), blocks_sink(spark, tmp_path)
    for _ in range(2):
        J.ingest(arriving, prepare, sink, str(tmp_path / "quarantine"), str(tmp_path / "state")).awaitTermination(240)
    got = sink.read()
    assert got.groupBy("id", "pos").count().where("count > 1").count() == 0 and got.where("id = 0").collect()[0].text == "Another text of the first."
    assert got.where("id <> 0").count() == prepare(docs.where("id <> 0")).count()
    assert spark.read.parquet(str(tmp_path / "quarantine")).count() == 0


def mail_files(spark, folder, *feeds):
    for rows in feeds:
        data = [(f"{i}.eml", f"Message-ID: <{m}>\nDate: {date}\nFrom: a@x\nTo: {to}\nSubject: {subject}\n\nbody\n".encode()) for i, (m, date, to, subject) in enumerate(rows)]
        spark.createDataFrame(data, "path string, content binary").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", 1).parquet(folder)


def test_mail_times(spark):
    dates = ["Mon, 1 Jan 2024 10:00:00 +0000", "1 Jan 2024 12:00:00 +0200", "Mon, 01 Jan 2024 10:00 GMT", "Mon, 1 Jan 2024 05:00:00 -0500 (EST)", "yesterday", "", None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, d string").select("i", J.mail_time(F.col("d")).alias("t")).orderBy("i").collect()
    assert len({r.t for r in rows[:4]}) == 1 and rows[0].t is not None and all(r.t is None for r in rows[4:])


def test_mail_stream(spark, tmp_path):
    """Copies in time are dropped as known, copies behind the watermark as late, and so is a new mail that comes too late."""
    day = lambda d: f"{d} Mar 2024 08:00:00 +0000"
    feeds = [
        [("0", day(1), "x", "Outage now"), ("1", day(2), "x", "Hello"), ("1", day(2), "x", "Hello"), ("u", "no date", "x", "Hello")],
        [("1", day(2), "x", "Hello"), ("2", day(20), "x", "Hello")],
        [("2", day(20), "x", "Hello"), ("3", day(15), "x", "Weekly update")],
        [("0", day(1), "x", "Outage now"), ("late", day(3), "x", "Hello")],
    ]
    files = mail_files(spark, str(tmp_path / "mail"), *feeds)
    triage = lambda rows: rows.select("message_id", M.triage(F.col("subject"), F.col("body"), F.col("sender"))["category"].alias("category"))
    got = run(spark, J.mail_stream(files, X.mail_rows, triage, "7 days"), tmp_path, "mail_out")
    assert got == [("<0>", "Urgent"), ("<1>", "Informational"), ("<2>", "Informational"), ("<3>", "Newsletter")]


def test_mailboxes_keep_their_newest(spark, tmp_path):
    minute = lambda m: f"1 Mar 2024 08:{m:02d}:00 +0000"
    feeds = [[("a", minute(5), "x", ""), ("b", minute(9), "x", ""), ("c", minute(1), "y", "")], [("d", minute(7), "x", ""), ("a", minute(5), "x", "")], [("e", minute(2), "x", ""), ("f", minute(9), "x", ""), ("g", minute(1), "y", "")]]
    files = mail_files(spark, str(tmp_path / "mail"), *feeds)
    mails = J.mail_stream(files, X.mail_rows, lambda rows: rows.select("message_id", "recipient", "sent"), "1 day")
    found = J.standing(J.drained(J.latest_mails(mails, "recipient", 2), str(tmp_path / "out"), "append"))
    assert sorted((r.key, r.message_id) for r in found.collect()) == [("x", "<b>"), ("x", "<f>"), ("y", "<c>"), ("y", "<g>")]


def test_equal_headers_are_parsed_once(monkeypatch):
    """What 40 mails share is parsed once, not several times a mail, and rows are those of the default policy."""
    import pyarrow as pa
    from email import message_from_bytes, policy
    from email.headerregistry import HeaderRegistry

    odd = [b"", b"Subject: =?utf-8?q?=C3=BCber?=\nFrom: \"A, B\" <a@x>\n\nx\xff", b"Content-Type: text/plain; charset=nowhere\n\nbody\xe9", b"Content-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/html\n\n<b>h</b>\n--q--\n", b"Subject: " + b"long " * 900 + b"\n\nx"]
    same = [f"Message-ID: <{i}@x>\nSubject: Same\nFrom: A <a@x>\nContent-Type: text/plain; charset=utf-8\n\nbody {i}\n".encode() for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(len(odd + same))], "content": odd + same})
    plain, parsed = HeaderRegistry.__call__, []
    monkeypatch.setattr(HeaderRegistry, "__call__", lambda self, name, value: parsed.append(name.lower()) or plain(self, name, value))
    rows = [r for out in X._mail_rows([batch]) for r in out.to_pylist()]
    assert parsed.count("content-type") < 10 and parsed.count("from") < 5
    for r, content in zip(rows, odd + same, strict=True):
        message = message_from_bytes(content, policy=policy.default)
        assert (r["subject"], r["sender"], r["body"]) == (X._header(message, "Subject", "(No Subject)"), X._header(message, "From", "Unknown Sender"), X._body(message))


def test_ingest_deals_its_files_by_the_input(spark, tiny, monkeypatch):
    """The arriving files of stream_ingest grow with the table's parts: no task gets a fixed share of all."""
    import re
    from pathlib import Path
    from loomdex.plans import event_queries as E
    from loomdex.shared import shared_folder
    from loomdex.sources.tables import table as plain

    monkeypatch.setattr(E, "table", lambda *args: plain(*args).repartition(12))
    root = Path(re.sub("^file:/*", "/", shared_folder(spark)))
    before = set(root.glob("ingest-*"))
    got = E.stream_ingest(spark, tiny).count()
    folder = (set(root.glob("ingest-*")) - before).pop()
    assert len(list(folder.glob("in/*.parquet"))) >= 12 and got > 0
