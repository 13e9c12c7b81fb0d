"""Jobs over events that run on tables and streams alike; streams need event time as a timestamp."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.shared import cut
from loomdex.sources.sink import KeyedTable
from loomdex.streaming.state import STORE, Latest, Segments, Tickets, keyed


def confirmations(tickets: DataFrame, confirms: DataFrame, seconds: int) -> DataFrame:
    """(ticket_id, key, issued, confirmed) of tickets (ticket_id, key, issued) and confirms (key, at): the first confirmation in time, else null."""
    other = confirms.withColumnRenamed("key", "c_key")
    in_time = (F.col("key") == F.col("c_key")) & (F.col("at") > F.col("issued")) & (F.col("at") <= F.col("issued") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return tickets.join(other, in_time, "left").groupBy("ticket_id", "key", "issued").agg(F.min("at").alias("confirmed"))


def stream_confirmations(events: DataFrame, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """confirmations() of one stream of both: events (key long, at, ticket_id long), where a null ticket_id is a confirmation.

    One row a ticket: its first confirmation as soon as no earlier one can come, or null
    once its time has passed. Events come in any order within `delay`. To be started by drained().
    """
    rows = events.select("key", "at", F.coalesce("ticket_id", F.lit(0)).alias("ticket_id"), F.col("ticket_id").isNotNull().alias("is_ticket"))
    settled = keyed(rows.withWatermark("at", delay), "key", Tickets(seconds * 1_000_000))
    return settled.select("ticket_id", "key", "issued", "confirmed")


def segments(events: DataFrame, gap: str, least_seconds: float) -> DataFrame:
    """(key, start, stop, n) of events (key, at): runs without a gap; runs shorter than `least_seconds` between first and last event drop out."""
    grouped = events.groupBy("key", F.session_window("at", gap)).agg(F.min("at").alias("start"), F.max("at").alias("stop"), F.count("*").alias("n"))
    return grouped.where(F.col("stop").cast("double") - F.col("start").cast("double") >= least_seconds).select("key", "start", "stop", "n")


def split_segments(events: DataFrame, gap_seconds: float, longest_seconds: float, least_seconds: float) -> DataFrame:
    """segments() on a table (key, at), where an event `longest_seconds` or more behind the start of its segment also ends it and opens the next.

    Where a segment ends depends on where it began, so the events between two gaps are
    folded in order; gaps are found before, and each run is folded apart.
    """
    order = Window.partitionBy("key").orderBy("at")
    rows = events.select("key", F.unix_micros("at").alias("at"))
    opens = F.coalesce(F.col("at") - F.lag("at").over(order) >= round(gap_seconds * 1e6), F.lit(True)).cast("int")
    rows = rows.withColumn("opens", opens)
    rows = rows.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.groupBy("key", "run").agg(F.sort_array(F.collect_list("at")).alias("times"))
    one = lambda start, stop, n: F.struct(start.alias("start"), stop.alias("stop"), n.alias("n"))
    first = F.col("times")[0]
    nothing = F.lit(0).cast("long")
    state = F.struct(first.alias("start"), first.alias("stop"), nothing.alias("n"), F.slice(F.array(one(first, first, nothing)), 1, 0).alias("done"))

    def step(held, at):
        breaks = at - held["start"] >= round(longest_seconds * 1e6)
        closed = F.concat(held["done"], F.array(one(held["start"], held["stop"], held["n"])))
        cut = F.struct(at.alias("start"), at.alias("stop"), F.lit(1).cast("long").alias("n"), closed.alias("done"))
        on = F.struct(held["start"].alias("start"), at.alias("stop"), (held["n"] + 1).alias("n"), held["done"].alias("done"))
        return F.when(breaks, cut).otherwise(on)

    folded = F.aggregate("times", state, step, lambda held: F.concat(held["done"], F.array(one(held["start"], held["stop"], held["n"]))))
    found = runs.select("key", F.inline(folded)).where(F.col("stop") - F.col("start") >= round(least_seconds * 1e6))
    return found.select("key", F.timestamp_micros("start").alias("start"), F.timestamp_micros("stop").alias("stop"), "n")


def stream_segments(events: DataFrame, gap_seconds: float, longest_seconds: float, least_seconds: float, delay: str = "0 seconds") -> DataFrame:
    """split_segments() of a stream (key long, at timestamp), whose events come in any order within `delay`. To be started by drained()."""
    sizes = [round(s * 1e6) for s in (gap_seconds, longest_seconds, least_seconds)]
    return keyed(events.select("key", "at").withWatermark("at", delay), "key", Segments(*sizes))


def rates(decisions: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, stop, tier, n) of decisions (at, tier) by time window; with `late`, a stream drops rows that come later."""
    if late is not None:
        decisions = decisions.withWatermark("at", late)
    grouped = decisions.groupBy(F.window("at", length, slide), "tier").agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "tier", "n")


def ingest(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], sink: KeyedTable, quarantine: str, checkpoint: str):
    """Starts a query that extracts arriving documents into a keyed table; what fails goes to the quarantine folder, the rest goes on.

    Of a key's documents in a batch the one of the highest version counts, and the table
    keeps the highest of all. `extract` gives rows for the table and, where it has a column
    `error`, the reason why a document failed: none of its rows is stored, and an older
    version stays. Quarantined are (key, version, error, batch). A batch that runs again
    gives the same table and overwrites its own folder of the quarantine.
    """
    key, version = sink.key, sink.version

    def write(batch: DataFrame, number: int) -> None:
        # documents equal in key and version are told apart by all they have
        order = Window.partitionBy(key).orderBy(F.desc(version), F.xxhash64(*batch.columns))
        newest = batch.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")
        rows = extract(newest)
        rows = cut(rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string")))
        failed = rows.where("error is not null").groupBy(key, version).agg(F.min("error").alias("error"))
        failed.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{quarantine}/part={number}")
        good = rows.join(failed.select(F.col(key).alias("__key")), F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        sink.upsert(good)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mail_time(date: Column) -> Column:
    """The time of a mail's Date header; null if it is none."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(date), r"^[A-Za-z]+,\s*", ""), r"\s*\([^)]*\)$", "")
    zoned = F.regexp_replace(plain, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(form)) for form in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")])


def mail_stream(files: DataFrame, parse: Callable[[DataFrame], DataFrame], triage: Callable[[DataFrame], DataFrame], delay: str = "7 days") -> DataFrame:
    """Arriving mail files (path, content), parsed and triaged once for each message id, by the time at which they were sent (column sent).

    A mail may arrive up to `delay` after others that were sent later. One that arrives again
    meanwhile is known and dropped; one that arrives again afterwards is too late, and is
    dropped as such. So no mail counts twice, however late its copy comes. Mails without a
    readable date have no place in time and are left out.
    """
    rows = parse(files).withColumn("sent", mail_time(F.col("date"))).where("sent is not null")
    return triage(rows.withWatermark("sent", delay).dropDuplicatesWithinWatermark(["message_id"]))


def latest_mails(mails: DataFrame, mailbox: str, n: int) -> DataFrame:
    """(key, message_id, sent, place, displaced) of a stream of mails with a watermark: each that enters the `n` newest of its mailbox. To be started by drained().

    State is `n` messages a mailbox. Of equal times the larger message id is newer.
    """
    return keyed(mails.select(F.col(mailbox).alias("key"), "message_id", "sent"), "key", Latest(n))


def standing(entries: DataFrame) -> DataFrame:
    """Of the rows of latest_mails() those that no other has displaced: what the mailboxes hold."""
    gone = entries.select(F.col("key").alias("__key"), F.col("displaced").alias("__gone")).where("__gone is not null")
    return entries.join(gone, F.col("key").eqNullSafe(F.col("__key")) & (F.col("message_id") == F.col("__gone")), "left_anti").drop("place", "displaced")


def drained(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """What a stream has given when all that is there has arrived; its rows and state are in the folder, not on the driver."""
    out, conf = f"{folder}/rows", stream.sparkSession.conf

    def write(batch: DataFrame, number: int) -> None:
        # each batch has its own folder, and a batch that runs again overwrites it; a complete result replaces all before it
        batch.write.mode("overwrite").parquet(f"{out}/last" if mode == "complete" else f"{out}/batch={number}")

    before = conf.get(STORE[0], None)
    conf.set(*STORE)
    try:
        # a stream keeps the store that it was started with
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        conf.unset(STORE[0]) if before is None else conf.set(STORE[0], before)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/last" if mode == "complete" else out).select(*stream.columns)
