"""Image files as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, image): decoded PNG and JPEG files with BGR bytes; the id is an MD5 of the pixels.

    Files that can't be decoded are left out.
    """
    raw = spark.read.format("image").option("dropInvalid", True).load(path)
    return raw.select(F.concat(F.lit("v2:"), F.md5("image.data")).alias("item_id"), "image")
