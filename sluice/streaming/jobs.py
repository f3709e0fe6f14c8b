"""Streaming forms: pruning, tumbling statistics, refinement ticks, existence cache."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sluice.operators import evaluate, prune, store, telemetry, views
from sluice.operators.shared import saved
from sluice.streaming import observed

#: Bounds of the histogram of a tick's scores.
SCORE_BOUNDS = tuple(k / 10 for k in range(1, 11))


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Landed event files as a stream of parsed events; the checkpoint holds the cursor."""
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(path)
    return prune.parse_events(raw)


def prune_stream(events: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, delay: str = "30 seconds", recorder: observed.Recorder | None = None, name: str = "prune") -> StreamingQuery:
    """Candidates, verdict columns from ``judge`` (images, reasons), survivors saved once, tally per minute.

    ``judge`` adds ``images`` and ``reasons`` to (event_time, group_id, cids). Replayed batches
    change nothing: survivors are inserted if absent, and a batch's tally replaces itself. Items are
    stored by day of the event, which a replay has as well, so a batch only looks at the days that it holds.

    A ``recorder`` gets the counts of the stages ``events``, ``candidates`` and ``judged`` of each batch, counted as
    the rows pass, and is flushed when the query ends; it can't stop the stream. A batch that is replayed is counted again.
    """
    if recorder is not None:
        events.sparkSession.streams.addListener(observed.StageCounts(recorder, name))
        events = observed.counted(events, "events")
    candidates = prune.extract_candidates(events.withWatermark("event_time", delay))
    if recorder is not None:
        candidates = observed.counted(candidates, "candidates", images=F.sum(F.size("cids")))

    def save(batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, Observation()
        one = judge(batch).withColumns({"posts": F.lit(1), "saved": F.when(F.size("reasons") == 0, F.col("images")).otherwise(0), "rejected": F.when(F.size("reasons") > 0, F.greatest("images", F.lit(1))).otherwise(0)})
        if recorder is not None:
            one = one.observe(seen, F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in ("posts", "images", "saved", "rejected")])
        one = one.persist()
        keep = one.where(F.size("reasons") == 0).select("group_id", "event_time", "cids", "original_at", F.to_date("event_time").alias("day"))
        items, days = f"{path}/items", [r["day"] for r in keep.select("day").distinct().collect()]  # the days of one batch
        base = spark.read.schema(keep.schema).parquet(items).where(F.col("day").isin(days)) if _exists(spark, items) else keep.limit(0)
        store.insert_if_absent(base, keep, "group_id").write.partitionBy("day").mode("append").parquet(items)
        minute = F.date_trunc("minute", "event_time").alias("interval_start")
        prune.tally(one, (minute,)).write.mode("overwrite").parquet(f"{path}/tally/batch={batch_id}")
        one.unpersist()
        if recorder is not None:
            observed.deliver(recorder, "judged", seen.get)

    return candidates.writeStream.queryName(name).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p)


def interval_tallies(stream: DataFrame, ts: str = "event_time", delay: str = "30 seconds") -> DataFrame:
    """T4: tumbling one-minute counts of seen, examined and saved, final once the watermark has passed."""
    w = F.window(ts, "1 minute")
    counts = stream.withWatermark(ts, delay).groupBy(w).agg(F.count("*").alias("seen"), F.count_if("examined").alias("examined"), F.count_if("saved").alias("saved"))
    return counts.select(F.col("window.start").alias("interval_start"), F.col("window.end").alias("interval_end"), "seen", "examined", "saved")


@dataclass
class Tick:
    """C4: what a tick of refinement comes to."""

    scores: DataFrame  # the table of scores with the new ones
    outcomes: DataFrame  # (outcome, n)
    watermark: DataFrame  # one row: where the next tick begins
    errors: DataFrame  # (reason, n) of what got no score
    histogram: DataFrame  # (le, n) of the new scores
    counts: DataFrame  # one row: unscored, scored, errors, remaining


def run_tick(items: DataFrame, scores: DataFrame, scorer: Callable, model_version: str, since: Column | None = None, bounds: tuple[float, ...] = SCORE_BOUNDS, **calls) -> Tick:
    """One tick. The backlog is scored once and saved; all tables come from there.

    Fallback scores aren't saved, so their items stay in the backlog. The watermark is the
    oldest discovered_at that is still open, else the newest seen. ``calls`` go to ``score_items``.
    """
    backlog = views.unscored(items, scores, since)
    done = evaluate.score_items(backlog, scorer, **calls).join(backlog.select("item_id", "discovered_at"), "item_id")
    done = saved(done.withColumn("model_version", F.lit(model_version)), "tick")
    good = done.where("outcome <> 'fallback'")
    merged = store.upsert(scores.select("item_id", "score", "model_version"), good.select("item_id", "score", "model_version"), "item_id")
    failed = F.col("outcome") == "fallback"
    counts = done.agg(F.count("*").alias("unscored"), F.count_if(~failed).alias("scored"), F.count_if(failed).alias("errors")).withColumn("remaining", F.col("unscored") - F.col("scored"))
    mark = done.agg(F.coalesce(F.min(F.when(failed, F.col("discovered_at"))), F.max("discovered_at")).alias("watermark"))
    errors = done.where(failed).groupBy(F.col("error").alias("reason")).agg(F.count("*").alias("n"))
    return Tick(merged, done.groupBy("outcome").agg(F.count("*").alias("n")), mark, errors, telemetry.histogram(good, "score", list(bounds)), counts)


def refine_tick(items: DataFrame, scores: DataFrame, scorer: Callable, model_version: str, since: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C4: (new scores table, outcome counts, next watermark) of ``run_tick``."""
    tick = run_tick(items, scores, scorer, model_version, since)
    return tick.scores, tick.outcomes, tick.watermark


def refresh_cache(cache: DataFrame, probed: DataFrame, now: Column, ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(merged cache, stale keys): new probes win, known dimensions stay if a probe has none."""
    new = probed.select("item_id", F.col("url_exists").alias("n_exists"), F.col("dimensions").alias("n_dimensions"), F.col("checked_at").alias("n_at"))
    both = cache.join(new, "item_id", "full")
    merged = both.select("item_id", F.coalesce("n_exists", "url_exists").alias("url_exists"), F.coalesce("n_dimensions", "dimensions").alias("dimensions"), F.coalesce("n_at", "checked_at").alias("checked_at"))
    stale = merged.where(F.unix_timestamp(now) - F.unix_timestamp("checked_at") > ttl_seconds).select("item_id")
    return merged, stale


class StageProgress(StreamingQueryListener):
    """Throughput and depth of the last finished triggers, out of band."""

    def __init__(self, keep: int = 1000) -> None:
        self.rows: deque[dict] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
