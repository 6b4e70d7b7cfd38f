"""New files as a stream: an extension of our own on top of the batch sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.sources.catalog import EXTENSIONS


def files(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, modificationTime, sha256 of image files as they arrive."""
    rows = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return rows.where(F.lower(F.substring_index("path", ".", -1)).isin(*extensions)).select("path", "modificationTime", F.sha2("content", 256).alias("sha256"))


def first_seen(stream: DataFrame, key: str = "sha256", at: str = "modificationTime", late: str = "7 days") -> DataFrame:
    """The first of each content within the watermark; state is dropped as it passes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tallies(stream: DataFrame, at: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; late rows count while the watermark allows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count(F.lit(1)).alias("n"))
