"""Stored tables by hash bucket, merged by rewriting the touched buckets only.

A row's bucket follows from its key. Data lie below ``data/generation=.../bucket=...``; a pointer row
says for each bucket which generation holds it. A batch is merged into the buckets that its keys fall into:
their rows are written as a new generation, and one pointer row is added last. Readers follow the newest
pointer row, so they see the table before or after a batch and nothing in between, and a
batch that is replayed finds its pointer row and does nothing.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.operators import store

POINTER = "version long, batch string, key string, buckets int, generations map<int,string>, schema string, rewritten array<int>"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _pointers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINTER).parquet(f"{path}/pointer")


def _current(spark: SparkSession, path: str):
    return _pointers(spark, path).orderBy(F.desc("version")).first()  # one row


def _write(rows: DataFrame, path: str, generation: str) -> None:
    """Writes rows that have a column ``bucket``; a generation that a broken attempt left is replaced bucket by bucket."""
    # large buckets are split among tasks and small ones put together
    rows = rows.withColumn("generation", F.lit(generation)).hint("rebalance", "bucket")
    rows.write.partitionBy("generation", "bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/data")


def _point(spark: SparkSession, path: str, version: int, batch: str, key: str, buckets: int, generations: dict[int, str], schema: str, rewritten: list[int]) -> None:
    spark.createDataFrame([(version, batch, key, buckets, generations, schema, rewritten)], POINTER).coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def create(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Stores ``df``, one row per key, as version 0. ``buckets`` should make one bucket a few files' worth of rows."""
    _write(df.withColumn("bucket", bucket_of(key, buckets)), path, "0")
    _point(df.sparkSession, path, 0, "", key, buckets, dict.fromkeys(range(buckets), "0"), df.schema.json(), list(range(buckets)))


def _at(spark: SparkSession, path: str, pointer, only: list[int] | None = None) -> DataFrame:
    """The rows of the buckets as a pointer row has them; the predicate prunes folders."""
    shape = StructType.fromJson(json.loads(pointer["schema"]))
    stored = StructType([*shape.fields]).add("generation", "string").add("bucket", "integer")
    by_generation: dict[str, list[int]] = {}
    for bucket, generation in pointer["generations"].items():
        if only is None or bucket in only:
            by_generation.setdefault(generation, []).append(bucket)
    held = F.lit(False)
    for generation, some in by_generation.items():
        held = held | ((F.col("generation") == generation) & F.col("bucket").isin(some))
    return spark.read.schema(stored).parquet(f"{path}/data").where(held)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of now, or of a version that ``vacuum`` hasn't taken away."""
    pointer = _current(spark, path) if version is None else _pointers(spark, path).where(F.col("version") == version).first()
    return _at(spark, path, pointer).drop("generation", "bucket")


def lookup(spark: SparkSession, path: str, keys: list) -> DataFrame:
    """The rows of a few keys; only their buckets are read."""
    pointer = _current(spark, path)
    asked = spark.createDataFrame([(k,) for k in keys], StructType([f for f in StructType.fromJson(json.loads(pointer["schema"])).fields if f.name == pointer["key"]]))
    only = [r[0] for r in asked.select(bucket_of(pointer["key"], pointer["buckets"])).distinct().collect()]
    return _at(spark, path, pointer, only).drop("generation", "bucket").where(F.col(pointer["key"]).isin(keys))


def merge(spark: SparkSession, path: str, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, seq: str | None = None) -> list[int]:
    """Deletes the keys of ``deletes``, then upserts; returns the buckets that were rewritten.

    ``batch`` names the batch: one that is already in does nothing, and one whose attempt broke off is written again in the
    same place. One writer at a time; readers as many as there are.
    """
    now = _current(spark, path)
    key, buckets = now["key"], now["buckets"]
    if _pointers(spark, path).where(F.col("batch") == batch).limit(1).count():
        return []
    own = bucket_of(key, buckets)
    keys = [df.select(own.alias("bucket")) for df in (upserts, deletes) if df is not None]
    touched = sorted({r["bucket"] for df in keys for r in df.distinct().collect()})  # as many as there are buckets at most
    if touched:
        rows = _at(spark, path, now, touched).drop("generation", "bucket")
        if deletes is not None:
            rows = store.delete_keys(rows, deletes, key)
        if upserts is not None:
            rows = store.upsert(rows, upserts, key, seq)
        generation = f"{now['version'] + 1}-{hashlib.md5(batch.encode()).hexdigest()[:8]}"
        _write(rows.withColumn("bucket", own), path, generation)
        _point(spark, path, now["version"] + 1, batch, key, buckets, now["generations"] | dict.fromkeys(touched, generation), now["schema"], touched)
    return touched


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes folders of buckets that none of the last ``keep`` versions reads; returns them."""
    last = _pointers(spark, path).orderBy(F.desc("version")).limit(keep).collect()
    used = {f"generation={g}/bucket={b}" for p in last for b, g in p["generations"].items()}
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/generation=*/bucket=*")) or []:
        where = status.getPath()
        name = f"{where.getParent().getName()}/{where.getName()}"
        if name not in used:
            fs.delete(where, True)
            gone.append(name)
    return sorted(gone)
