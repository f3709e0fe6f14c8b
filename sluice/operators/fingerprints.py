"""Fingerprints of stored tables that are kept up file by file.

The token of a table is an order-free sum of row hashes, so it is also the sum of its files'
tokens. A small table holds a row per file; a refresh lists the files, hashes the new ones only, and leaves
out those that are gone. A gate over many large inputs then reads what changed since it last ran.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE_KEY = ["file", "size", "modified"]
TOKENS = "file string, size long, modified timestamp, n long, token decimal(38,0)"


def row_hash(columns: list[str]) -> Column:
    """The hash of a row whose sum is a token, as ``store.snapshot_token`` has it."""
    return F.xxhash64(*columns)


def portable_hash(columns: list[str]) -> Column:
    """A row hash that other engines have as well: 60 bits of the md5 of the values as text, each after its length, null as -1."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    told = [F.concat(F.when(F.col(c).isNull(), "-1").otherwise(F.length(t).cast("string")), F.lit(":"), t) for c, t in zip(columns, text, strict=True)]
    return F.conv(F.substring(F.md5(F.concat(*told)), 1, 15), 16, 10).cast("bigint")


def _data(spark: SparkSession, path: str, schema: StructType, files: list[str] | None = None) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(*([path] if files is None else files))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, modified) of the data files below ``path``; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_tokens(data: DataFrame, hashed: Callable[[list[str]], Column] = row_hash) -> DataFrame:
    """(file, n, token): rows and the sum of row hashes of each file of a DataFrame read from files."""
    rows = data.select(F.col("_metadata.file_path").alias("file"), hashed(data.columns).cast("decimal(20,0)").alias("h"))
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.sum("h").cast("decimal(38,0)").alias("token"))


def refresh(spark: SparkSession, path: str, schema: StructType, known_path: str, hashed: Callable[[list[str]], Column] = row_hash) -> dict:
    """Brings the file tokens below ``known_path`` up to date with the table below ``path`` and returns
    {n, token, added, removed}: rows, token, files hashed and files gone.

    A file is known by name, size and time. Versions of the small table lie side by side and one pointer row names the
    current one, written last: a refresh that breaks off leaves the last version, and is done again. Files without rows count, too.
    """
    there = listing(spark, path).persist()
    known = known_tokens(spark, known_path)
    fresh = there.join(known, FILE_KEY, "left_anti").persist()
    kept = known.join(there, FILE_KEY, "left_semi")
    added = [r["file"] for r in fresh.select("file").collect()]  # names of new files, which a scan of them needs on the driver anyway
    removed = known.count() - kept.count()
    if added or removed:
        if added:
            tokens = fresh.join(file_tokens(_data(spark, path, schema, added), hashed), "file", "left")
            kept = kept.unionByName(tokens.select(*FILE_KEY, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("token", F.lit(0)).cast("decimal(38,0)").alias("token")))
        version = uuid.uuid4().hex
        kept.coalesce(1 + len(added) // 100_000).write.parquet(f"{known_path}/versions/{version}")
        spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{known_path}/pointer")
    total = known_tokens(spark, known_path).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("token"), F.lit(0)).cast("decimal(38,0)").alias("token")).first()
    there.unpersist()
    fresh.unpersist()
    return {"n": total["n"], "token": total["token"], "added": len(added), "removed": removed}


def known_tokens(spark: SparkSession, known_path: str) -> DataFrame:
    """The current table of file tokens; empty before the first refresh."""
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{known_path}/pointer")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return spark.createDataFrame([], TOKENS)
    now = spark.read.schema("version string, at timestamp").parquet(f"{known_path}/pointer").orderBy(F.desc("at")).first()  # one row
    return spark.read.schema(TOKENS).parquet(f"{known_path}/versions/{now['version']}")


def gate(spark: SparkSession, tables: dict[str, tuple[str, StructType]], known_path: str, publish: Callable[[], None], has_lists: bool = True) -> bool:
    """Calls ``publish`` if an input changed since it last succeeded, or no list is there; whether it did.

    ``tables`` has (path, schema) by name. The tokens that a publish was made from are remembered after it, so one that fails is done again.
    """
    now = {name: refresh(spark, path, schema, f"{known_path}/{name}") for name, (path, schema) in sorted(tables.items())}
    rows = spark.createDataFrame([(name, t["n"], str(t["token"])) for name, t in now.items()], "name string, n long, token string")
    seen_path = f"{known_path}/published"
    seen = spark._jvm.org.apache.hadoop.fs.Path(seen_path)
    exists = seen.getFileSystem(spark._jsc.hadoopConfiguration()).exists(seen)
    if exists and has_lists:
        last = spark.read.parquet(seen_path)
        last = last.where(F.col("at") == last.agg(F.max("at")).first()[0])
        if {(r["name"], r["n"], r["token"]) for r in last.collect()} == {(r["name"], r["n"], r["token"]) for r in rows.collect()}:  # a row per table
            return False
    publish()
    rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(seen_path)
    return True
