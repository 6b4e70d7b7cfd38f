"""Files and folders as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiltframe.functions.text import category_of_file

EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp")


def scan(spark: SparkSession, path: str, recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, name, length, modificationTime, content of the image files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.substring_index("path", "/", -1)
    return files.where(F.lower(F.substring_index(name, ".", -1)).isin(*extensions)).withColumn("name", name)


def ingested(spark: SparkSession, path: str, least: int = 10, most: int = 20_000) -> DataFrame:
    """One row per image file: path, name, sha256, width, height, status, error; a bad file is a FAILED row."""
    files = scan(spark, path).select("path", "name", F.sha2("content", 256).alias("sha256"))
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select(F.col("image.origin").alias("origin"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = files.join(images, plain(F.col("path")) == plain(F.col("origin")), "left").drop("origin")
    ok = F.col("width").between(least, most) & F.col("height").between(least, most)
    error = F.when(F.coalesce(F.col("width"), F.lit(-1)) < 0, "cannot be decoded").when(~ok, "size out of bounds")
    return rows.withColumn("status", F.when(error.isNull(), "OK").otherwise("FAILED")).withColumn("error", error)


def source_ids(df: DataFrame) -> DataFrame:
    """Adds id: 16 digits of sha256, 24 where two contents share those, src_%04d of ``i`` for failed files."""
    clash = df.groupBy(F.substring("sha256", 1, 16).alias("__p")).agg((F.min("sha256") != F.max("sha256")).alias("__c"))
    rows = df.withColumn("__p", F.substring("sha256", 1, 16)).join(clash, "__p", "left")
    own = F.when(F.col("__c"), F.substring("sha256", 1, 24)).otherwise(F.col("__p"))
    return rows.withColumn("id", F.when(F.col("status") == "FAILED", F.format_string("src_%04d", "i")).otherwise(own)).drop("__p", "__c")


def categorised(files: DataFrame, known: list[str]) -> DataFrame:
    """Files whose name starts with a known category and an underscore."""
    return files.withColumn("category", category_of_file(F.col("filename"))).where(F.col("category").isin(*known))


def first_per_code(df: DataFrame, code: Column, order: str) -> DataFrame:
    """The first row per case-folded code."""
    w = Window.partitionBy(F.lower(code.cast("string"))).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def next_suffix(names: DataFrame, stem: str) -> DataFrame:
    """The first free number of a run's files: none taken, 1; else one above the highest."""
    n = F.regexp_extract("name", "^" + stem + r"(?:_([0-9]+))?$", 1)
    taken = names.where(F.col("name").rlike("^" + stem + r"(?:_[0-9]+)?$")).select(F.when(n == "", 1).otherwise(n.try_cast("int")).alias("n"))
    return taken.agg((F.coalesce(F.max("n"), F.lit(0)) + 1).alias("next"))


def inputs_of(files: DataFrame) -> DataFrame:
    """Images to read: known extensions, and not named like a finished account (ten capitals or digits)."""
    name, ext = F.regexp_replace("filename", r"\.[^.]*$", ""), F.lower(F.substring_index("filename", ".", -1))
    return files.where(ext.isin(*EXTENSIONS) & ~name.rlike("^[A-Z0-9]{10}$"))


def group_of_folder(path: Column, groups: dict[str, str]) -> Column:
    """The group of the nearest path component that names one."""
    from quiltframe.functions.text import folder_key

    known = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    hits = F.filter(F.transform(F.reverse(F.split(path, "/")), lambda p: F.try_element_at(known, folder_key(p))), lambda g: g.isNotNull())
    return F.when(F.size(hits) > 0, F.element_at(hits, 1))


def indexed(new: DataFrame, existing: int, order: str) -> DataFrame:
    """source_index counts on from what exists; duplicates use up a number too, so there may be gaps later.

    Numbers are dealt by range: only the counts per range reach the driver, no single task sorts all rows. Range
    bounds are sampled anew whenever a plan runs, so ranges and ranks are written down once, before they are counted.
    """
    rows = new.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy("__p").orderBy(order)
    rows = kept(rows.withColumn("__r", F.row_number().over(w)))
    sizes = {r["__p"]: r["k"] for r in rows.groupBy("__p").agg(F.max("__r").alias("k")).collect()}
    before, run = [], existing
    for p in range(max(sizes, default=-1) + 1):
        before.append(run)
        run += sizes.get(p, 0)
    start = F.element_at(F.array(*[F.lit(b) for b in before or [existing]]), F.col("__p") + 1)
    return rows.withColumn("source_index", (start + F.col("__r") - 1).cast("int")).drop("__p", "__r")


def folder(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``). Only a local session, as in tests, may do without: it gets one in its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir") + "/quiltframe"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
