"""Table operators: append, upsert, delete, point and set reads, paging, intervals, tokens
(S4-S13, J7, W5, W6, A1-A6, U2-U4, T9, T10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    """Appends; an empty batch writes nothing."""
    if not df.isEmpty():
        df.write.mode("append").parquet(path)


def upsert(base: DataFrame, new: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """One row per key; a new row replaces the stored one. Of several new rows with a
    key the one with the largest ``seq`` wins (ties, or no ``seq``: the largest row).

    One aggregation over both sides, combined on the map side.
    """
    cols = [c for c in base.columns if c != key]
    row = F.struct(*cols)
    order = lambda df, fresh: F.struct(F.lit(fresh).alias("fresh"), (df[seq] if seq else F.lit(0)).alias("seq"), row.alias("row"))
    both = base.select(key, row.alias("row"), order(base, 0).alias("o")).unionByName(new.select(key, row.alias("row"), order(new, 1).alias("o")))
    return both.groupBy(key).agg(F.max_by("row", "o").alias("row")).select(key, "row.*").select(*base.columns)


def set_reviews(base: DataFrame, new: DataFrame, key: str, at: Column) -> DataFrame:
    """Reviews (key, band, appraiser, appraised_at) with those of ``new`` (key, band, appraiser) set and stamped."""
    return upsert(base, new.withColumn("appraised_at", at).select(*base.columns), key, "appraised_at")


def clear_reviews(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The reviews but those of the keys; clearing what isn't there changes nothing."""
    return delete_keys(base, keys, key)


def all_reviews(item_reviews: DataFrame, group_reviews: DataFrame) -> DataFrame:
    """Every review as (kind, id, band, appraiser, appraised_at)."""
    one = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "band", "appraiser", "appraised_at")
    return one(item_reviews, "item", "item_id").unionByName(one(group_reviews, "group", "group_id"))


def delete_keys(base: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key is not in ``keys``; absent keys don't matter."""
    return base.join(keys.select(on).distinct(), on, "left_anti").select(*base.columns)


def insert_if_absent(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` to append: those whose key isn't stored, one per key."""
    fresh = new.join(base.select(key).distinct(), key, "left_anti")
    cols = [c for c in new.columns if c != key]
    return fresh.groupBy(key).agg(F.min(F.struct(*cols)).alias("row")).select(key, "row.*").select(*new.columns)


def get(base: DataFrame, key: str, value) -> DataFrame:
    """At most one row; the predicate reaches the scan."""
    return base.where(F.col(key) == F.lit(value)).limit(1)


def multi_get(base: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of a key set; an empty set gives none."""
    return base.join(keys.select(on).distinct(), on, "left_semi").select(*base.columns)


def summaries(items: DataFrame, payload: tuple[str, ...] = ("payload", "annotated")) -> DataFrame:
    """Every column but the payloads, which the scan then never reads."""
    return items.drop(*payload)


def with_payload(summary: DataFrame, payloads: DataFrame, on: str = "item_id", annotated: bool = False) -> DataFrame:
    """Items with their original, and annotated, payload from its own table."""
    return summary.join(payloads.select(on, "payload", *(["annotated"] if annotated else [])), on)


def validate(spark: SparkSession, path: str, stamp, number: int) -> DataFrame:
    """Appends one (timestamp, random_number) row, reads it back and says whether it is there."""
    row = spark.createDataFrame([(stamp, number)], "timestamp timestamp, random_number long")
    append(row, path)
    back = spark.read.parquet(path).where((F.col("timestamp") == F.lit(stamp)) & (F.col("random_number") == number))
    return back.agg((F.count("*") > 0).alias("ok"))


def page(df: DataFrame, before: Column | None, limit: int, ts: str = "discovered_at", tie: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(rows, cursor): the newest ``limit`` rows strictly before the cursor, newest first.

    The cursor table has the last row's timestamp if more rows remained, else no row.
    """
    rows = df if before is None else df.where(F.col(ts) < before)
    ahead = rows.orderBy(F.desc(ts), tie).limit(limit + 1 if limit else 0)
    shown = ahead.orderBy(F.desc(ts), tie).limit(limit)
    more = ahead.agg(F.count("*").alias("n"))
    cursor = shown.agg(F.min(ts).alias("cursor")).crossJoin(more).where(F.col("n") > limit).select("cursor")  # one row by one row
    return shown, cursor


def newest_ids(df: DataFrame, since: Column | None = None, key: str = "item_id", ts: str = "discovered_at") -> DataFrame:
    """W6."""
    rows = df if since is None else df.where(F.col(ts) >= since)
    return rows.select(key, ts).orderBy(F.desc(ts), key)


def extremes(df: DataFrame, ts: str = "discovered_at") -> DataFrame:
    """A1."""
    return df.agg(F.min(ts).alias("oldest"), F.max(ts).alias("newest"))


def in_interval(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """Half open."""
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def count_by_version(scores: DataFrame) -> DataFrame:
    """A3."""
    return scores.groupBy("model_version").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model_version")


def distinct_groups(items: DataFrame, ts: str = "discovered_at") -> DataFrame:
    """A4: each group once, with when it was first seen."""
    return items.groupBy("group_id").agg(F.min(ts).alias("first_seen"))


def interval_stats(stats: DataFrame, start: Column, end: Column) -> DataFrame:
    """Totals of the intervals that start in [start, end), with widened bounds; zeros
    between the bounds asked for when there are none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    kind = stats.schema["interval_start"].dataType
    return in_interval(stats, "interval_start", start, end).agg(
        F.coalesce(F.min("interval_start"), start.cast(kind)).alias("interval_start"),
        F.coalesce(F.max("interval_end"), end.cast(kind)).alias("interval_end"),
        total("seen"), total("examined"), total("saved"),
    )


def fill_intervals(stats: DataFrame) -> DataFrame:
    """T4: one row per minute from the first to the last interval; minutes without any have zeros. (One number per minute is made.)"""
    minute = F.expr("INTERVAL 1 MINUTE")
    span = stats.agg(F.min("interval_start").alias("a"), F.max("interval_start").alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", minute)).alias("interval_start"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("seen", "examined", "saved")]
    return every.join(stats.drop("interval_end"), "interval_start", "left").select("interval_start", (F.col("interval_start") + minute).alias("interval_end"), *zero)


def latest_end(stats: DataFrame) -> DataFrame:
    """A6."""
    return stats.agg(F.max("interval_end").alias("latest"))


def snapshot_token(df: DataFrame) -> DataFrame:
    """(n, token): row count and an order-free sum of row hashes, decimal so that it can't overflow."""
    h = F.xxhash64(*df.columns).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("token"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two tables hold the same rows, repeats counted."""
    gone, new = a.exceptAll(b), b.exceptAll(a)
    return gone.limit(1).unionAll(new.limit(1)).agg((F.count("*") == 0).alias("same"))


def add_to_blocklist(base: DataFrame, new: DataFrame) -> DataFrame:
    """(uri, reason), stored reasons first; sorted."""
    both = base.select("uri", "reason", F.lit(0).alias("o")).unionAll(new.select("uri", "reason", F.lit(1).alias("o")))
    return both.groupBy("uri").agg(F.min_by("reason", F.struct("o", "reason")).alias("reason")).orderBy("uri")


def insert_unique(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """U4: the union; an error if a key is there twice."""
    both = base.unionByName(new)
    twice = F.col("n") > 1
    checked = both.groupBy(key).agg(F.count("*").alias("n")).withColumn("ok", F.when(twice, F.raise_error(F.concat(F.lit("duplicate key: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True))
    return both.join(checked.where("ok").select(key), key, "left_semi").select(*base.columns)
