"""What several corpus operators share: table access, the shared work folder, word rules."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
#: The same rule as a Java regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder; a
    cluster without it is an error, since a machine-local folder would lose files.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Folders of one operator's intermediate tables; those that are superseded are removed.

    Only a table that nothing still to be computed reads may be dropped.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, f"{self.name}-{name}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def view(self, df: DataFrame, other: DataFrame) -> DataFrame:
        """``other``, which is ``df`` in another form, now stands for its folder."""
        self.paths[id(other)] = (other, self.paths.pop(id(df))[1])
        return other

    def drop(self, *dfs: DataFrame | None) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in dfs:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)

    def keep(self, *dfs: DataFrame) -> None:
        """Drops all tables but these, which are all that the result still reads."""
        kept = {id(df) for df in dfs}
        self.drop(*[df for k, (df, _) in list(self.paths.items()) if k not in kept])


#: Whole texts are long: rows and bytes of an Arrow batch, where the session has Spark's own limits (the values before).
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, unless the session says how large they may be."""
    for key, (usual, ours) in BATCH_LIMITS.items():
        if spark.conf.get(key, None) == usual:
            spark.conf.set(key, ours)


@contextmanager
def without_gc() -> Iterator[None]:
    """No cyclic garbage collection in loops that make no cycles: each would walk the whole caches."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_words(col: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def words(col: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    inner = F.btrim(F.coalesce(col, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
