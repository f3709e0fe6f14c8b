"""Keyed state with timers: interval records and the existence cache.

Both need Spark's RocksDB state store: set ``STATE_STORE`` on the session before the query starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MINUTE_MS = 60_000
COUNTS = ("seen", "examined", "saved")


class IntervalWriter(StatefulProcessor):
    """One record per minute without gaps, written in batches; what couldn't be written stays in state.

    Input are closed minutes. A minute without rows is closed as empty by the next row after it, or by the timer at
    its end when the watermark gets there. Records are held until ``every`` of them are there and handed to ``write``; if that
    raises, they are held for the next row or timer. What was written comes out as rows, so a sink may take them as well.
    """

    def __init__(self, write: Callable[[list[dict]], None] | None, every: int) -> None:
        self.write, self.every = write, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "at long")  # start of the minute that is to be closed next, in ms
        self.held = handle.getListState("held", "start long, seen long, examined long, saved long")

    def _hold(self, records: list[tuple], upcoming: int) -> None:
        self.held.appendList(records)
        self.next.update((upcoming,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(upcoming + MINUTE_MS)

    def _flush(self) -> Iterator[Row]:
        records = [dict(zip(("start", *COUNTS), r, strict=True)) for r in self.held.get()]
        if len(records) < self.every:
            return
        try:
            if self.write is not None:
                self.write(records)
        except Exception:  # a writer that fails must not stop the stream
            return
        self.held.clear()
        for r in records:
            yield Row(start_ms=r["start"], **{c: r[c] for c in COUNTS})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        records, upcoming = [], self.next.get()[0] if self.next.exists() else None
        for r in sorted(rows, key=lambda r: r["start_ms"]):
            while upcoming is not None and upcoming < r["start_ms"]:
                records.append((upcoming, 0, 0, 0))
                upcoming += MINUTE_MS
            records.append((r["start_ms"], *(r[c] for c in COUNTS)))
            upcoming = r["start_ms"] + MINUTE_MS
        self._hold(records, upcoming)
        yield from self._flush()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        upcoming, now, records = self.next.get()[0], timerValues.getCurrentWatermarkInMs(), []
        while upcoming + MINUTE_MS <= now:
            records.append((upcoming, 0, 0, 0))
            upcoming += MINUTE_MS
        self._hold(records, upcoming)
        yield from self._flush()


def interval_records(stream: DataFrame, ts: str = "event_time", delay: str = "30 seconds", write: Callable[[list[dict]], None] | None = None, every: int = 1) -> DataFrame:
    """T4: (interval_start, interval_end, seen, examined, saved) of every minute up to the watermark, empty ones too.

    ``stream`` has (ts, examined, saved). Events are counted per minute by a window, with partial counts on the map side; only
    the closed minutes, a row each, meet in the one key that keeps their order.
    """
    counts = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 minute")).agg(F.count("*").alias("seen"), F.count_if("examined").alias("examined"), F.count_if("saved").alias("saved"))
    closed = counts.select(F.window_time("window").alias("at"), F.unix_millis("window.start").alias("start_ms"), *COUNTS, F.lit("all").alias("of"))
    out = closed.groupBy("of").transformWithState(IntervalWriter(write, every), "start_ms long, seen long, examined long, saved long", "Append", "EventTime")
    start = F.timestamp_millis("start_ms")
    return out.select(start.alias("interval_start"), (start + F.expr("INTERVAL 1 MINUTE")).alias("interval_end"), *COUNTS)


class ExistenceCache(StatefulProcessor):
    """What is known of an item's address, for as long as it is fresh.

    An item that is seen for the first time, or again after its answer expired, is to be probed; each is asked for once until an
    answer comes. The timer at the end of an answer's life asks anew. Dimensions stay when a later probe has none.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "url_exists boolean, dimensions string, checked_ms long, asked boolean")

    def _out(self, key, action: str, entry: tuple) -> Row:
        return Row(item_id=key[0], action=action, url_exists=entry[0], dimensions=entry[1], checked_ms=entry[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        entry = tuple(self.entry.get()) if self.entry.exists() else (None, None, None, False)
        before, answered, seen = entry, False, False
        for r in sorted(rows, key=lambda r: r["at_ms"]):
            if r["kind"] != "probe":
                seen = True
            elif entry[2] is None or r["at_ms"] >= entry[2]:  # an older answer that comes late changes nothing
                entry, answered = (r["url_exists"], r["dimensions"] if r["dimensions"] is not None else entry[1], r["at_ms"], False), True
        if answered:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(entry[2] + self.ttl_ms)
            yield self._out(key, "known", entry)
        elif seen and not entry[3] and entry[2] is None:
            entry = (*entry[:3], True)
            yield self._out(key, "probe", entry)
        if entry != before:
            self.entry.update(entry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        entry = (*tuple(self.entry.get())[:3], True)
        self.entry.update(entry)
        yield self._out(key, "probe", entry)


def existence_stream(sightings: DataFrame, ttl_seconds: int, delay: str = "30 seconds") -> DataFrame:
    """(item_id, action, url_exists, dimensions, checked_at): ``known`` for each answer that is taken in, ``probe`` for
    each item to ask about, with what is known of it so far.

    ``sightings`` has (item_id, kind, url_exists, dimensions, at), kind ``seen`` or ``probe``. Times are event times, so a
    replay expires what the first run expired.
    """
    rows = sightings.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    out = rows.groupBy("item_id").transformWithState(ExistenceCache(1000 * ttl_seconds), "item_id string, action string, url_exists boolean, dimensions string, checked_ms long", "Append", "EventTime")
    return out.select("item_id", "action", "url_exists", "dimensions", F.timestamp_millis("checked_ms").alias("checked_at"))
