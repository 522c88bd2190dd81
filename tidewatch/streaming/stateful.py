"""Streams with state of their own, by ``transformWithStateInPandas``.

State is one small row for each key, or a few (days of the rate gate, open threads); batches of a key arrive as
pandas frames. T5 and T6 sort a key's micro-batch by time, the others take it frame by frame. The state store is RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ts", "id"])


class StayQuiet(StatefulProcessor):
    """T5: a row only when a key turns from healthy to failed or back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was, out = (self.last.get()[0] if self.last.exists() else "ok"), []
        for r in _sorted(rows).itertuples():
            now = "failed" if r.status == "failed" else "ok"
            if now != was:
                out.append((key[0], r.id, r.ts, now))
            was = now
        self.last.update((was,))
        yield pd.DataFrame(out, columns=["key", "id", "ts", "now"])

    def close(self) -> None:
        pass


class RetryEscalate(StatefulProcessor):
    """Consecutive failures count as attempts; the ``cap``-th escalates, a success starts anew."""

    cap = 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.attempts = handle.getValueState("attempts", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, out = (self.attempts.get()[0] if self.attempts.exists() else 0), []
        for r in _sorted(rows).itertuples():
            n = n + 1 if r.status == "failed" else 0
            if n:
                out.append((key[0], r.id, r.ts, n, "escalate" if n >= self.cap else "retry"))
        self.attempts.update((n,))
        yield pd.DataFrame(out, columns=["key", "id", "ts", "attempt", "action"])

    def close(self) -> None:
        pass


class RateGate(StatefulProcessor):
    """The first ``cap`` proposals of each key and day pass; days are forgotten."""

    cap, keep_days, ttl_ms = 2, 3, 7 * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getMapState("passed", "day int", "n int", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = pd.DataFrame(columns=["id", "ts", "day"])
        newest = None
        for chunk in rows:  # of each day no more than ``cap`` rows are held
            chunk = chunk[["id", "ts"]].assign(day=_micros(chunk["ts"]) // 86_400_000_000)
            newest = max(int(chunk["day"].max()), newest if newest is not None else int(chunk["day"].max()))
            both = pd.concat([first, chunk]) if len(first) else chunk
            first = both.sort_values(["ts", "id"]).groupby("day").head(self.cap)
        known = {int(k[0]) for k, _ in self.passed.iterator()} if self.passed.exists() else set()
        closed = max(known) - self.keep_days if known else None
        out = []
        for day, some in first.groupby("day"):
            if closed is not None and day <= closed:
                continue
            n = self.passed.getValue((int(day),))[0] if int(day) in known else 0
            for r in some.itertuples():
                if n < self.cap:
                    n += 1
                    out.append((key[0], r.id, r.ts, n))
            self.passed.updateValue((int(day),), (n,))
            known.add(int(day))
        for day in known:
            if day <= max(newest, max(known)) - self.keep_days:
                self.passed.removeKey((day,))
        yield pd.DataFrame(out, columns=["key", "id", "ts", "place"])

    def close(self) -> None:
        pass


class Threads(StatefulProcessor):
    """Alerts of a key without a gap of ``gap`` microseconds are one thread; late alerts lengthen and join threads that are still kept."""

    gap, keep = 2 * 3_600_000_000, 2 * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "thread long, first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(int(x) for x in t) for t in self.open.get()] if self.open.exists() else []
        threads = list(before)
        for chunk in rows:  # each frame becomes its few threads at once
            threads = self.joined(threads + [(at, at, at, 1) for at in _micros(chunk["ts"].dropna()).tolist()])
        changed = [t for t in threads if t not in before]
        kept = {t[0] for t in threads}
        gone = [(name, next(t[0] for t in threads if t[1] <= first <= t[2])) for name, first, _, _ in before if name not in kept]
        newest = max((t[2] for t in threads), default=0)
        self.open.put([t for t in threads if t[2] >= newest - self.keep])
        out = [(key[0], *t, None) for t in changed] + [(key[0], name, None, None, 0, into) for name, into in gone]
        yield pd.DataFrame(out, columns=["key", "thread", "first", "last", "n", "joined"]).astype({"joined": "Int64", "first": "Int64", "last": "Int64"})

    def joined(self, threads: list[tuple]) -> list[tuple]:
        """Neighbours within the gap as one, under the name of the first one known."""
        out: list[tuple] = []
        for name, first, last, n in sorted(threads, key=lambda t: (t[1], t[0])):
            if out and first < out[-1][2] + self.gap:
                was = out[-1]
                out[-1] = (was[0], was[1], max(was[2], last), was[3] + n)
            else:
                out.append((name, first, last, n))
        return out

    def close(self) -> None:
        pass


def _micros(ts: pd.Series) -> pd.Series:
    return ts.dt.as_unit("us").astype("int64")


class Heartbeat(StatefulProcessor):
    """A row when a key has been silent for ``quiet_ms`` of event time (a breach of its freshness)."""

    quiet_ms = 24 * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # chunk by chunk: a key's rows are never held together
        newest = max(int(chunk["ts"].max().timestamp() * 1000) for chunk in rows)
        newest = max(newest, self.last.get()[0] if self.last.exists() else 0)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((newest,))
        self.handle.registerTimer(newest + self.quiet_ms)
        yield pd.DataFrame([], columns=["key", "last_ms", "due_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], self.last.get()[0], expiredTimerInfo.getExpiryTimeInMs())], columns=["key", "last_ms", "due_ms"])

    def close(self) -> None:
        pass


def stay_quiet(events: DataFrame) -> DataFrame:
    """events: key, id, ts, status."""
    return events.groupBy("key").transformWithStateInPandas(StayQuiet(), "key long, id long, ts timestamp, now string", "Append", "None")


def retry_escalate(events: DataFrame, cap: int = 3) -> DataFrame:
    processor = RetryEscalate()
    processor.cap = cap
    return events.groupBy("key").transformWithStateInPandas(processor, "key long, id long, ts timestamp, attempt int, action string", "Append", "None")


def rate_gate(proposals: DataFrame, cap: int = 2, keep_days: int = 3, ttl_hours: float = 168) -> DataFrame:
    """The first ``cap`` proposals of each entity and day, with their place. proposals: key (the entity), id, ts.

    State is a count for each of an entity's last ``keep_days`` days: older ones go when newer days
    come, and nothing passes on a day that was forgotten. What an entity leaves behind that
    isn't heard of any more goes after ``ttl_hours`` of processing time.
    """
    processor = RateGate()
    processor.cap, processor.keep_days, processor.ttl_ms = cap, keep_days, int(ttl_hours * 3_600_000)
    kind = proposals.schema["key"].dataType.simpleString()
    return proposals.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, id long, ts timestamp, place int", "Append", "ProcessingTime")


def incident_threads(alerts: DataFrame, gap_hours: float = 2, keep_hours: float = 48) -> DataFrame:
    """Changes of threads: key, thread, first, last (microseconds), n, joined. alerts: key, ts; null times don't count.

    A thread that grows is told again under its name (the time of the alert it began with), one that is
    joined into an earlier one with n = 0 and the other's name. Threads that ended ``keep_hours`` before the
    key's newest alert are settled and leave the state. ``upsert_threads`` keeps the table.
    """
    processor = Threads()
    processor.gap, processor.keep = int(gap_hours * 3_600_000_000), int(keep_hours * 3_600_000_000)
    kind = alerts.schema["key"].dataType.simpleString()
    return alerts.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, thread long, first long, last long, n long, joined long", "Update", "None")


def heartbeat(events: DataFrame, quiet_hours: float, late: str = "1 hour") -> DataFrame:
    """Silent keys, once each silence; fires when the watermark passes the due time at the end of a batch."""
    processor = Heartbeat()
    processor.quiet_ms = int(quiet_hours * 3_600_000)
    return events.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(processor, "key long, last_ms long, due_ms long", "Append", "EventTime")
