"""Counts of a stream's stages, delivered to recorders out of band.

Stages are counted by ``DataFrame.observe`` while their rows pass, so nothing is read twice. A listener hands
each batch's counts to the recorder that the caller implements, and flushes it when the query ends.
"""

from __future__ import annotations

import logging
from collections import deque
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


class Recorder(Protocol):
    """What takes counts. A recorder that doesn't buffer leaves ``flush`` empty."""

    def record(self, stage: str, counts: dict[str, int]) -> None:
        """The counts of one batch in one stage."""

    def flush(self) -> None:
        """Called once when the query has ended, so that what is buffered isn't lost."""


class Totals:
    """A recorder that adds up: ``totals[stage][name]``, and the rows between stages."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}
        self.flushed = 0

    def record(self, stage: str, counts: dict[str, int]) -> None:
        own = self.totals.setdefault(stage, {})
        for name, n in counts.items():
            own[name] = own.get(name, 0) + n

    def flush(self) -> None:
        self.flushed += 1

    def depth(self, first: str, then: str, name: str = "rows") -> int:
        """Rows that have left one stage and not yet another."""
        return self.totals.get(first, {}).get(name, 0) - self.totals.get(then, {}).get(name, 0)


def counted(df: DataFrame, stage: str, **counts: Column) -> DataFrame:
    """The rows, counted as they pass: ``rows`` and the named aggregates."""
    return df.observe(f"stage:{stage}", F.count("*").alias("rows"), *[c.alias(n) for n, c in counts.items()])


def deliver(recorder: Recorder, stage: str, counts: dict) -> None:
    """Hands counts over; a recorder that fails is logged and doesn't stop the stream."""
    try:
        recorder.record(stage, {k: v or 0 for k, v in counts.items()})
    except Exception:
        log.exception("a recorder failed on stage %s", stage)


class StageCounts(StreamingQueryListener):
    """Delivers the counts of a query's stages batch by batch, and keeps the throughput of the last triggers."""

    def __init__(self, recorder: Recorder, query: str, keep: int = 1000) -> None:
        self.recorder, self.query = recorder, query
        self.progress: deque[dict] = deque(maxlen=keep)
        self.id: str | None = None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.query:
            self.id = str(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name != self.query:
            return
        self.progress.append({"batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond, "millis": p.durationMs.get("triggerExecution") if p.durationMs else None})
        for name, row in (p.observedMetrics or {}).items():
            if name.startswith("stage:"):
                deliver(self.recorder, name.removeprefix("stage:"), row.asDict())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.id) != self.id:
            return
        self.id = None
        try:
            self.recorder.flush()
        except Exception:
            log.exception("a recorder failed to flush")
