"""Keyed state for streams: what a batch computes over whole keys, as rows arrive and time passes.

Rows of a key may come in any order within the watermark's delay. A processor keeps them
until the watermark has passed them, so it settles events in the order of their time, gives
every result once, and holds only what is still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed processors need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def _stamps(micros: list) -> pd.Series:
    return pd.Series(pd.to_datetime(pd.Series(micros, dtype="Int64"), unit="us")).astype("datetime64[us]")


class _Timed(StatefulProcessor):
    """A processor that settles a key whenever the watermark passes the next time that matters to it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def settle(self, key: tuple, now: int) -> tuple[pd.DataFrame, list[int]]:
        """Rows that are certain now (microseconds), and the times at which more will be."""
        raise NotImplementedError

    def wait(self, times: list[int]) -> None:
        """A timer for the first of some times, and no other."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            # the first whole millisecond that is not before it
            self.handle.registerTimer(-(-min(times) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows, times = self.settle(key, timerValues.getCurrentWatermarkInMs() * 1000)
        self.wait(times)
        yield rows


class Tickets(_Timed):
    """Tickets of a key and the first confirmation of each within its time; one row a ticket, null if it expires."""

    SHAPE = "key long, ticket_id long, issued timestamp, confirmed timestamp"

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "ticket_id long, issued long")
        self.confirms = handle.getListState("confirms", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, ticket, kind in zip(_micros(frame["at"]), frame["ticket_id"].tolist(), frame["is_ticket"].tolist(), strict=True):
                if kind:
                    self.open.appendValue((int(ticket), at))
                else:
                    self.confirms.appendValue((at,))
        self.wait(self._times([t for _, t in self._open()], self._confirms()))
        yield pd.DataFrame({"key": [], "ticket_id": [], "issued": [], "confirmed": []}).astype({"key": "int64", "ticket_id": "int64", "issued": "datetime64[us]", "confirmed": "datetime64[us]"})

    def _open(self) -> list[tuple[int, int]]:
        return [tuple(t) for t in self.open.get()] if self.open.exists() else []

    def _confirms(self) -> list[int]:
        return sorted(c[0] for c in self.confirms.get()) if self.confirms.exists() else []

    def _times(self, issued: list[int], confirms: list[int]) -> list[int]:
        return [t + self.micros for t in issued] + confirms

    def settle(self, key: tuple, now: int) -> tuple[pd.DataFrame, list[int]]:
        tickets, confirms, done = self._open(), self._confirms(), []
        left = []
        for ticket, issued in tickets:
            first = next((c for c in confirms if issued < c <= issued + self.micros), None)
            # no earlier confirmation can come once the watermark has passed this one, and none at all after the ticket's time
            if (first is not None and first <= now) or issued + self.micros <= now:
                done.append((key[0], ticket, issued, first))
            else:
                left.append((ticket, issued))
        # a confirmation that time has passed has settled all tickets before it, and later ones it cannot confirm
        later = [c for c in confirms if c > now]
        _put(self.open, left)
        _put(self.confirms, [(c,) for c in later])
        out = pd.DataFrame({"key": pd.Series([d[0] for d in done], dtype="int64"), "ticket_id": pd.Series([d[1] for d in done], dtype="int64"), "issued": _stamps([d[2] for d in done]), "confirmed": _stamps([d[3] for d in done])})
        return out, self._times([t for _, t in left], later)


class Segments(_Timed):
    """Segments of a key's events, which end at a gap or at a length; the event that breaks the length opens the next."""

    SHAPE = "key long, start timestamp, stop timestamp, n long"

    def __init__(self, gap: int, longest: int, least: int):
        self.gap, self.longest, self.least = gap, longest, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "at long")
        self.open = handle.getValueState("open", "start long, stop long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at in _micros(frame["at"]):
                self.waiting.appendValue((at,))
        times = [w[0] for w in self.waiting.get()] if self.waiting.exists() else []
        self.wait(times + ([self.open.get()[1] + self.gap] if self.open.exists() else []))
        yield self._frame(key, [])

    def _frame(self, key: tuple, done: list[tuple[int, int, int]]) -> pd.DataFrame:
        done = [d for d in done if d[1] - d[0] >= self.least]
        return pd.DataFrame({"key": pd.Series([key[0]] * len(done), dtype="int64"), "start": _stamps([d[0] for d in done]), "stop": _stamps([d[1] for d in done]), "n": pd.Series([d[2] for d in done], dtype="int64")})

    def settle(self, key: tuple, now: int) -> tuple[pd.DataFrame, list[int]]:
        times = sorted(w[0] for w in self.waiting.get()) if self.waiting.exists() else []
        held = tuple(self.open.get()) if self.open.exists() else None
        done, later = [], [t for t in times if t > now]
        for t in times[: len(times) - len(later)]:
            if held and (t - held[1] >= self.gap or t - held[0] >= self.longest):
                done.append(held)
                held = None
            held = (held[0], t, held[2] + 1) if held else (t, t, 1)
        if held and held[1] + self.gap <= now:
            done.append(held)
            held = None
        _put(self.waiting, [(t,) for t in later])
        if held:
            self.open.update(held)
        else:
            self.open.clear()
        return self._frame(key, done), later + ([held[1] + self.gap] if held else [])


class Latest(_Timed):
    """The `n` newest messages of a mailbox: a row for each that enters them, with its place on entry and what it displaced."""

    SHAPE = "key string, message_id string, sent timestamp, place long, displaced string"

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getListState("kept", "sent long, message_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = sorted((at, m) for frame in rows for at, m in zip(_micros(frame["sent"]), frame["message_id"].tolist(), strict=True))
        kept, out = [tuple(k) for k in self.kept.get()] if self.kept.exists() else [], []
        for at, message in arrived:
            newest = sorted([*kept, (at, message)], reverse=True)
            gone = newest[self.n :]
            kept = newest[: self.n]
            if (at, message) in kept:
                out.append((key[0], message, at, kept.index((at, message)), gone[0][1] if gone else None))
        _put(self.kept, kept)
        yield pd.DataFrame({"key": [o[0] for o in out], "message_id": [o[1] for o in out], "sent": _stamps([o[2] for o in out]), "place": pd.Series([o[3] for o in out], dtype="int64"), "displaced": pd.Series([o[4] for o in out], dtype="object")})


def _put(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


def keyed(rows: DataFrame, key: str, processor: StatefulProcessor, time_mode: str = "EventTime") -> DataFrame:
    """The processor's rows for each key of a stream with a watermark; the stream has to be started under STORE."""
    return rows.groupBy(F.col(key).alias("key")).transformWithStateInPandas(processor, processor.SHAPE, "Append", time_mode)
