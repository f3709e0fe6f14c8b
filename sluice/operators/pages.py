"""Pages of a stored table by the bounds of its files.

Rows are written in the order of their time, so each file holds a short span of it, and a small table says
which. A page then reads the newest files until the next one can't hold anything that belongs
before its last row. Batches that are appended may overlap in time with older ones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.operators import store

BOUNDS = "file string, rows long, lo_us long, hi_us long, schema string, ts string, tie string"


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def append(df: DataFrame, path: str, ts: str = "discovered_at", tie: str = "item_id", rows_per_file: int = 1_000_000) -> None:
    """Adds rows in the order of (ts, tie) and the bounds of the files made for them; rows without a time aren't shown and are refused.

    Data come first: files without bounds, left by an attempt that broke off, aren't read.
    """
    spark, shape = df.sparkSession, df.schema.json()
    timed = F.when(F.col(ts).isNull(), F.raise_error(F.lit(f"no {ts}")).cast(df.schema[ts].dataType)).otherwise(F.col(ts))
    batch = f"{path}/data/{uuid.uuid4().hex}"
    rows = df.withColumn(ts, timed).repartitionByRange(ts, tie).sortWithinPartitions(ts, tie)
    rows.write.option("maxRecordsPerFile", rows_per_file).parquet(batch)
    made = spark.read.schema(df.schema).parquet(batch).groupBy(F.col("_metadata.file_path").alias("file"))
    made = made.agg(F.count("*").alias("rows"), F.min(_micros(F.col(ts))).alias("lo_us"), F.max(_micros(F.col(ts))).alias("hi_us"))
    made.select("*", F.lit(shape).alias("schema"), F.lit(ts).alias("ts"), F.lit(tie).alias("tie")).coalesce(1).write.mode("append").parquet(f"{path}/bounds")


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, lo_us, hi_us, ...): a row per file."""
    return spark.read.schema(BOUNDS).parquet(f"{path}/bounds")


def _read(spark: SparkSession, files: list) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(files[0]["schema"]))).parquet(*[f["file"] for f in files])


def page(spark: SparkSession, path: str, before_us: int | None, limit: int) -> tuple[DataFrame, int | None, list[str]]:
    """(rows, cursor, files): the newest ``limit`` rows strictly before the cursor, newest first, ties by the tie column.

    The cursor is the last row's time in microseconds if more rows remain, else None; ``files`` are those that were
    read. Files are taken newest first until they surely hold one row more than the page, then all that reach up to the last
    of these rows: a border may run through rows of one time.
    """
    known = bounds(spark, path)
    if before_us is not None:
        known = known.where(F.col("lo_us") < before_us)
    # whole files before the cursor hold at least a row each, so limit + 1 of them are enough, and those the cursor runs through
    through = known.where(F.col("hi_us") >= before_us).collect() if before_us is not None else []
    whole = known if before_us is None else known.where(F.col("hi_us") < before_us)
    newest = whole.orderBy(F.desc("hi_us"), "file").limit(limit + 1).collect()
    if not (through or newest):
        return (_empty(spark, path), None, [])
    sure, chosen = 0, list(through)
    for f in newest:
        if sure > limit:
            break
        chosen.append(f)
        sure += f["rows"]
    ts, tie = chosen[0]["ts"], chosen[0]["tie"]
    mine = lambda files: _read(spark, files).where(F.lit(True) if before_us is None else _micros(F.col(ts)) < before_us)
    # the time of the row after the page among these files: nothing older can be on the page
    last = mine(chosen).select(_micros(F.col(ts)).alias("t")).orderBy(F.desc("t")).limit(limit + 1).agg(F.min("t"), F.count("*")).first()
    remain = last[1] > limit  # if not, the files are all there are before the cursor
    if remain:
        have = {f["file"] for f in chosen}
        chosen += [f for f in whole.where(F.col("hi_us") >= last[0]).collect() if f["file"] not in have]
    shown = mine(chosen).orderBy(F.desc(ts), tie).limit(limit)
    cursor = shown.agg(F.min(_micros(F.col(ts)))).first()[0] if remain else None
    return shown, cursor, [f["file"] for f in chosen]


def _empty(spark: SparkSession, path: str) -> DataFrame:
    one = bounds(spark, path).first()
    return spark.createDataFrame([], StructType.fromJson(json.loads(one["schema"])) if one else StructType())


def newest_ids(spark: SparkSession, path: str, since_us: int | None = None) -> DataFrame:
    """(tie, ts) of the rows since a time, newest first; only files that reach it are read."""
    known = bounds(spark, path) if since_us is None else bounds(spark, path).where(F.col("hi_us") >= since_us)
    files = known.collect()  # a row per file, which a scan needs on the driver anyway
    if not files:
        return _empty(spark, path)
    ts, tie = files[0]["ts"], files[0]["tie"]
    rows = _read(spark, files) if since_us is None else _read(spark, files).where(_micros(F.col(ts)) >= since_us)
    return store.newest_ids(rows, None, tie, ts)
