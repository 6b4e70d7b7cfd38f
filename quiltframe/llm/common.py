"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only white space the corpus operators know.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session, as in tests, may do without: it gets one in its warehouse."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/quiltframe")
    return spark.sparkContext.getCheckpointDir()


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to the shared folder for the length of one operator: they survive lost executors and are small, being compressed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        """Deletes a table; what was computed from it must have been kept elsewhere before."""
        deleted(self.spark, path)
        self.paths.remove(path)

    def clear(self) -> None:
        for path in list(self.paths):
            self.drop(path)


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what is no longer referred to."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(values: Sequence[int]) -> Column:
    """An array of longs that folds into one literal."""
    if not len(values):
        return F.array().cast("array<long>")
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<long>")


def last_at_most(bounds: Sequence[Sequence[int]], key: Sequence[Column]) -> Column:
    """How many of the ascending ``bounds`` (tuples as long as ``key``) are at most ``key``, by binary search.

    The search is an expression over literal arrays, one step per bit, so a row costs the
    logarithm of the number of bounds and no join is needed.
    """
    n = len(bounds)
    if n == 0:
        return F.lit(0)
    arrays = [longs([b[i] for b in bounds]) for i in range(len(key))]
    steps = [1 << i for i in reversed(range(n.bit_length()))]

    def reached(at: Column) -> Column:
        found = F.lit(True)
        for a, k in reversed(list(zip(arrays, key))):
            here = F.element_at(a, at)
            found = (here < k) | ((here == k) & found)
        return found

    def step(at: Column, jump: Column) -> Column:
        to = at + jump
        return F.when((to <= n) & reached(F.least(to, F.lit(n))), to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)
